import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from helpers import START, column, gappy, same, sparse_grid, telemetry, times
from sparkwatch.functions.percentiles import exact_percentiles, grouped_percentiles
from sparkwatch.operators import grid
from sparkwatch.schema import as_telemetry, within_bounds


def test_duplicates_are_averaged_and_nan_is_missing(spark):
    rows = [(START.to_pydatetime(), "a", "m", v) for v in (1.0, 3.0, float("nan"))]
    got = grid.cells(as_telemetry(spark.createDataFrame(rows, "timestamp timestamp, service string, metric string, value double")))
    assert [r["value"] for r in got.collect()] == [2.0]


def test_axis_counts_distinct_times_across_days(spark):
    stamps = [START + pd.Timedelta(hours=h) for h in (0, 1, 23, 24, 25, 24 * 40, 24 * 40 + 1)]
    df = spark.createDataFrame([(s.to_pydatetime(),) for s in stamps for _ in range(2)], "timestamp timestamp")
    got = grid.time_axis(df).orderBy("timestamp").collect()
    assert [r["pos"] for r in got] == list(range(7))


def test_times_without_any_value_and_empty_series_vanish(spark):
    g = sparse_grid(spark, {("a", "m"): [1.0, np.nan, 3.0], ("b", "m"): [np.nan] * 3})
    assert g.select("pos").distinct().count() == 2
    assert grid.dense(g).count() == 2


def test_dense_has_every_series_at_every_time(spark):
    g = sparse_grid(spark, {("a", "m"): [1.0, 2.0, 3.0], ("b", "m"): [np.nan, 5.0, np.nan]})
    d = grid.dense(g)
    assert d.count() == 6
    assert column(d, "value", "b") == [None, 5.0, None]


def test_positions_count_times_strictly_before(spark):
    g = sparse_grid(spark, {("a", "m"): range(2000)})
    asked = [START, START + pd.Timedelta("30s"), START + pd.Timedelta(minutes=1500), START + pd.Timedelta(days=9), START - pd.Timedelta(days=3)]
    pts = spark.createDataFrame([(a.to_pydatetime(),) for a in asked], "timestamp timestamp")
    got = {r["timestamp"]: r["before"] for r in grid.positions_of(grid.axis_of(g), pts).collect()}
    assert sorted(got.values()) == [0, 0, 1, 1500, 2000]


def test_a_million_times_in_one_hour(spark):
    first = int(START.timestamp()) * 1_000_000 + 7
    micros = F.lit(first) + F.col("id") * 3599
    times = spark.range(0, 1_000_000, 1, 8).select(F.timestamp_micros(micros).alias("timestamp"), F.col("id"))
    placed = grid.time_axis(times).join(times, "timestamp")
    assert placed.where("pos = id").count() == 1_000_000
    points = spark.createDataFrame([(first - 1,), (first,), (first + 3599 * 500_000 + 1,), (first + 10**12,)], "at long").select(F.timestamp_micros("at").alias("timestamp"))
    got = sorted(r["before"] for r in grid.positions_of(grid.time_axis(times), points).collect())
    assert got == [0, 0, 500_001, 1_000_000]


def test_step_is_the_median_gap(spark):
    g = sparse_grid(spark, {("a", "m"): range(50)}, step=15)
    assert grid.require_step(g) == 15.0


def test_step_needs_two_times(spark):
    with pytest.raises(ValueError, match="two timestamps"):
        grid.require_step(sparse_grid(spark, {("a", "m"): [1.0]}))


def test_split_cuts_at_the_floor(spark):
    train, test = grid.split(sparse_grid(spark, {("a", "m"): range(11)}), 0.7)
    assert (train.count(), test.count()) == (7, 4)


def test_wide_and_back(spark):
    long = telemetry(spark, {("a", "m"): [1.0, 2.0], ("b", "k"): [np.nan, 4.0]})
    w = grid.wide(long, ["a/m", "b/k", "c/none"])
    assert w.columns == ["timestamp", "a/m", "b/k", "c/none"]
    back = grid.unpivot(w)
    assert back.count() == 6
    assert column(back, "value", "b", "k") == [None, 4.0]


def test_first_label_wins_and_missing_label_is_not_clean(spark):
    t0 = START.to_pydatetime()
    rows = [(t0, "a", "m", 1.0, False, 1), (t0, "a", "m", 3.0, True, 2), (t0, "b", "m", 1.0, None, 3), (t0, "c", "m", 1.0, True, 4)]
    df = spark.createDataFrame(rows, "timestamp timestamp, service string, metric string, value double, is_anomalous boolean, n int")
    got = {r["service"]: (r["value"], r["clean"]) for r in grid.clean_cells(df, ["n"]).collect()}
    assert got == {"a": (2.0, True), "b": (1.0, False), "c": (1.0, False)}


def test_bounds(spark):
    rows = [("error_rate", 1.5), ("cpu_pct", 140.0), ("mem_mb", 5e6), ("mem_mb", -1.0), ("error_rate", None)]
    df = spark.createDataFrame(rows, "metric string, v double")
    got = [r[0] for r in df.select(within_bounds(F.col("metric"), F.col("v"))).collect()]
    assert got == [1.0, 100.0, 5e6, 0.0, None]


@pytest.mark.parametrize("kind", ["normal", "ties", "signs", "narrow", "outlier", "one", "infinite", "NaN"])
def test_percentiles_by_narrowing_equal_the_builtin(spark, kind):
    rng = np.random.default_rng(3)
    n = 3000
    values = {
        "normal": rng.normal(0, 10, n),
        "ties": rng.integers(0, 4, n).astype(float),
        "signs": np.concatenate([-np.exp(rng.normal(0, 8, n // 2)), np.zeros(5), np.exp(rng.normal(0, 8, n // 2))]),
        "narrow": 2048 + rng.normal(0, 1e-6, n),
        "outlier": np.append(rng.normal(5, 1, n), 1e300),
        "one": np.array([7.25]),
        "infinite": np.concatenate([rng.normal(0, 1, n), [np.inf] * 200, [-np.inf] * 40, [-0.0, 0.0, 5e-324, -5e-324, 1.7e308]]),
        "NaN": np.concatenate([rng.normal(0, 1, 50), [np.nan] * 30, [np.inf] * 3]),
    }[kind]
    # one key holds most of the rows
    rows = [("hot", float(v)) for v in values] + [("cold", float(v)) for v in values[: max(1, len(values) // 7)]]
    df = spark.createDataFrame(rows, "k string, v double")
    levels = [0.0, 0.01, 0.25, 0.5, 0.95, 1.0]
    spark_own = F.percentile("v", F.array(*[F.lit(p) for p in levels])).alias("levels")
    want = {r["k"]: r["levels"] for r in df.groupBy("k").agg(spark_own).collect()}
    got = {r["k"]: r["levels"] for r in exact_percentiles(df, ["k"], "v", levels).collect()}
    assert got.keys() == want.keys()
    for k in want:
        np.testing.assert_allclose(got[k], want[k], rtol=1e-12)


@pytest.mark.parametrize("ordered", [3, 100])
def test_percentiles_of_cells_that_are_cut_again(spark, ordered):
    rng = np.random.default_rng(5)
    values = {"narrow": 2048 + rng.normal(0, 1e-6, 800), "wide": rng.normal(0, 10, 800), "same": np.full(50, 3.5), "ends": np.append(1.5 + rng.normal(0, 1e-9, 60), [1e300, -1e300, 4e299])}
    df = spark.createDataFrame([(k, float(v)) for k, vs in values.items() for v in vs], "k string, v double")
    levels = [0.0, 0.05, 0.5, 0.51, 0.99, 1.0]
    got = {r["k"]: r["levels"] for r in exact_percentiles(df, ["k"], "v", levels, ordered=ordered).collect()}
    assert got.keys() == values.keys()
    for k, vs in values.items():
        np.testing.assert_allclose(got[k], np.percentile(np.sort(vs), [100 * p for p in levels]), rtol=1e-12)


def test_percentiles_of_several_groupings_and_missing_keys(spark):
    rng = np.random.default_rng(6)
    rows = [(k, h, float(v)) for v, k, h in zip(rng.integers(0, 50, 900), rng.choice(["a", "b", None], 900), rng.integers(0, 3, 900).tolist())]
    rows += [("a", None, 7.0), ("a", None, 9.0), ("gone", 1, None)]
    df = spark.createDataFrame(rows, "k string, h int, v double")
    both, by_k, whole = grouped_percentiles(df, [["k", "h"], ["k"], []], "v", [0.25, 0.5])
    want = lambda keep: np.percentile([r[2] for r in rows if r[2] is not None and keep(r)], [25, 50])
    assert both.columns == ["k", "h", "levels", "rows"] and both.count() == 10 and by_k.count() == 3
    for r in both.collect():
        assert r["levels"] == pytest.approx(want(lambda x: (x[0], x[1]) == (r["k"], r["h"])))
    for r in by_k.collect():
        assert r["levels"] == pytest.approx(want(lambda x: x[0] == r["k"]))
        assert r["rows"] == sum(x[0] == r["k"] and x[2] is not None for x in rows)
    assert whole.first()["levels"] == pytest.approx(want(lambda x: True)) and whole.first()["rows"] == 902
    assert exact_percentiles(df.where("v > 100"), ["k"], "v", [0.5]).collect() == []


def test_chunks_do_not_change_windows(spark):
    g = sparse_grid(spark, {("a", "m"): gappy(300), ("b", "m"): gappy(300, 1)})
    for back in (1, 7):
        w = grid.chunk_window()
        whole = grid.own_rows(grid.chunked(g, back).withColumn("x", grid.at_lag(w, back)))
        cut = grid.own_rows(grid.chunked(g, back, rows=11).withColumn("x", grid.at_lag(w, back)))
        assert whole.count() == cut.count() == g.count()
        assert whole.exceptAll(cut).count() == 0


def test_first_label_that_is_there_counts(spark):
    at = START.to_pydatetime()
    rows = [(at, "a", "m", 1.0, None, "0"), (at, "a", "m", 1.0, False, "1"), (at, "b", "m", 1.0, None, "0"), (at, "c", "m", 1.0, True, "0"), (at, "c", "m", 1.0, False, "1")]
    df = spark.createDataFrame(rows, "timestamp timestamp, service string, metric string, value double, is_anomalous boolean, place string")
    got = {r["service"]: r["clean"] for r in grid.clean_cells(df, ["place"]).collect()}
    assert got == {"a": True, "b": False, "c": False}
