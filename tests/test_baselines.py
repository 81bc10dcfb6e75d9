import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from helpers import column, gappy, same, sparse_grid, telemetry, times
from sparkwatch.operators import baselines, grid
from sparkwatch.plans import alerting


def full(values):
    """Next to a series that is never missing, so that every position exists."""
    return {("a", "m"): values, ("z", "m"): np.arange(len(values), dtype=float)}


def test_seasonal_recovers_a_cycle_and_ignores_a_bad_day(spark):
    cycle = np.tile(np.sin(np.arange(24)), 5)
    got = column(baselines.seasonal_naive(grid.dense(sparse_grid(spark, full(cycle))), 24), "predicted")
    same(got[72:], cycle[72:])
    flat = np.full(120, 50.0)
    flat[2 * 24 + 5] = 5000.0
    got = column(baselines.seasonal_naive(grid.dense(sparse_grid(spark, full(flat))), 24), "predicted")
    assert got[4 * 24 + 5] == 50.0


def test_seasonal_uses_the_lags_there_are(spark):
    values = gappy(100, 4, 0.4)
    s = pd.Series(values)
    want = pd.concat([s.shift(7 * k) for k in (1, 2, 3)], axis=1).median(axis=1)
    for rows in (None, 13):
        got = column(baselines.seasonal_naive(grid.dense(sparse_grid(spark, full(values))), 7, chunk_rows=rows), "predicted")
        same(got, list(want))


@pytest.mark.parametrize("halflife", [0.05, 0.5, 20.0])
def test_ewma_matches_pandas_across_blocks_and_gaps(spark, halflife):
    values = gappy(900, 5, 0.3)
    values[200:480] = np.nan
    want = pd.Series(values).shift(1).ewm(halflife=halflife, min_periods=5).mean()
    got = column(baselines.ewma(grid.dense(sparse_grid(spark, full(values))), halflife), "predicted")
    same(got, list(want), 1e-9)


def test_ewma_does_not_peek_or_overflow(spark):
    values = np.ones(30_000)
    values[-1] = 900.0
    got = column(baselines.ewma(sparse_grid(spark, {("a", "m"): values}), 5.0), "predicted")
    assert got[-1] == pytest.approx(1.0)


@pytest.mark.parametrize("window,rows", [(20, None), (20, 7), (48, None), (48, 50), (240, 97)])
def test_rolling_matches_pandas_on_sparse_and_dense(spark, window, rows):
    values = gappy(600, 6, 0.25)
    values[300:420] = 7.1
    values[100] = 1e7
    s = pd.Series(values).shift(1).rolling(window, min_periods=window // 4)
    exact_std = [np.nan if np.isnan(m) else np.nanstd(x, ddof=1) for m, x in zip(s.mean(), windows(values, window))]
    exact_mean = [np.nan if np.isnan(m) else np.nanmean(x) for m, x in zip(s.mean(), windows(values, window))]
    g = sparse_grid(spark, full(values))
    dense = baselines.with_rolling(grid.dense(g), window, rows)
    same(column(dense, "mean"), exact_mean, 1e-9)
    same(column(dense, "std"), exact_std, 1e-6)
    sparse = baselines.with_rolling(g, window, rows)
    same(column(sparse, "std"), [e for e, v in zip(exact_std, values) if not np.isnan(v)], 1e-6)


def windows(values, n):
    return [np.append(values[max(0, i - n) : i], []) for i in range(len(values))]


def test_flat_window_has_no_deviation(spark):
    got = baselines.with_rolling(sparse_grid(spark, {("a", "m"): [0.1] * 300}), 240)
    assert set(column(got, "std")[60:]) == {0.0}
    assert not any(column(baselines.k_sigma_alerts(sparse_grid(spark, {("a", "m"): [0.1] * 300})), "alert"))


def test_spike_is_flagged_and_normal_data_rarely(spark):
    rng = np.random.default_rng(1)
    values = np.append(rng.normal(50, 1, 400), 250.0)
    assert column(baselines.k_sigma_alerts(sparse_grid(spark, {("a", "m"): values})), "alert")[-1]
    many = baselines.k_sigma_alerts(sparse_grid(spark, {("a", "m"): rng.normal(0, 1, 20_000)}))
    rate = np.mean(column(many, "alert"))
    assert 0.001 < rate < 0.008


def test_alert_rate_and_projection(spark):
    rows = [(s, i < 10 and s == "a") for s in "ab" for i in range(2880)]
    df = spark.createDataFrame(rows, "service string, alert boolean")
    row = baselines.alert_rate(df, 60.0, fleet=2000).first()
    assert row["alerts_per_series_per_day"] == pytest.approx(2.5)
    assert row["daily_alerts"] == pytest.approx(5000)
    assert baselines.alert_rate(df.limit(0), 60.0).first()["alerts_per_series_per_day"] == 0.0


def test_threshold_cost_counts_missing_cells_and_knows_four_ks(spark):
    g = sparse_grid(spark, full(gappy(500, 8, 0.3)))
    rows = {r["k"]: r for r in alerting.threshold_cost(g, alerting.grid_cells(g), 60.0, 48, ks=(2.0, 2.25)).collect()}
    assert rows[2.25]["inflation"] is None
    dense = baselines.k_sigma_alerts(grid.dense(g), 48, 2.0)
    want = baselines.alert_rate(dense, 60.0).first()["alerts_per_series_per_day"]
    assert rows[2.0]["alerts_per_series_per_day"] == pytest.approx(want)


def test_cells_that_cannot_be_judged(spark):
    g = grid.dense(sparse_grid(spark, full(gappy(60, 9, 0.3))))
    loud = baselines.k_sigma_alerts(g, 40)
    strict = baselines.k_sigma_alerts(g, 40, evaluated_only=True)
    assert loud.where("alert is null").count() == 0
    assert 0 < strict.where("alert is null").count() < 120
    assert baselines.alert_rate(loud, 60.0).first()["cells"] == 120
    assert baselines.alert_rate(strict, 60.0).first()["cells"] == 120 - strict.where("alert is null").count()


def test_partition_count_and_row_order_do_not_matter(spark):
    g = sparse_grid(spark, {("a", "m"): gappy(300, 10), ("b", "m"): gappy(300, 11)})
    want = sorted(map(str, baselines.ewma(baselines.with_rolling(g, 48)).collect()))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "1")
        shuffled = g.orderBy(F.rand(3))
        assert sorted(map(str, baselines.ewma(baselines.with_rolling(shuffled, 48)).collect())) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_alert_rate_of_an_empty_sparse_grid(spark):
    g = sparse_grid(spark, {("a", "m"): [1.0, 2.0]}).where("pos > 5")
    alerts = baselines.k_sigma_alerts(g, window=4)
    row = baselines.alert_rate(alerts, 60.0, alerting.grid_cells(g), fleet=7).first()
    assert (row["alerts"], row["cells"], row["alerts_per_series_per_day"], row["daily_alerts"]) == (0, 0, 0.0, 0.0)
