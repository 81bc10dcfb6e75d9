import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from helpers import column, gappy, same, sparse_grid
from sparkwatch.operators import baselines, features, grid

SMALL = features.FeatureSpec(day=40, windows=(12, 60))


def test_names_and_default_spec():
    spec = features.spec_for_step(15)
    assert spec.day == 5760
    assert len(spec.names) == 17
    assert spec.names[:5] == ["lag_1", "lag_2", "lag_4", "lag_8", "lag_16"]


def test_values_match_pandas(spark):
    values = gappy(260, 2, 0.15)
    g = grid.dense(sparse_grid(spark, {("a", "m"): values, ("z", "m"): np.ones(260)}))
    s = pd.Series(values)
    want = {f"lag_{n}": s.shift(n) for n in (1, 2, 4, 8, 16)}
    want["delta_1"], want["delta_4"] = s.shift(1) - s.shift(2), s.shift(1) - s.shift(5)
    for w in (12, 60):
        want[f"mean_{w}"] = s.shift(1).rolling(w, min_periods=w // 4).mean()
        want[f"std_{w}"] = s.shift(1).rolling(w, min_periods=w // 4).std()
    want["lag_day_1"], want["lag_day_2"] = s.shift(40), s.shift(80)
    built = features.build(g, SMALL, chunk_rows=90)
    for name, expected in want.items():
        same(column(built, name), list(expected), 1e-9)
    assert built.columns == g.columns + SMALL.names


def test_nothing_peeks(spark):
    values = gappy(300, 3, 0.0)
    other = values.copy()
    other[200] += 99.0
    a, b = (features.build(sparse_grid(spark, {("a", "m"): v}), SMALL).drop("value") for v in (values, other))
    changed = a.exceptAll(b).agg(F.min("pos")).first()[0]
    assert changed == 201


def test_midnight_wraps(spark):
    df = spark.createDataFrame([("2026-05-09 23:59:20",), ("2026-05-10 00:00:00",), ("2026-05-09 15:30:00",)], "t string")
    rows = df.select(F.col("t").cast("timestamp").alias("timestamp")).select(*features.calendar()).collect()
    near = abs(rows[0]["day_sin"] - rows[1]["day_sin"]) + abs(rows[0]["day_cos"] - rows[1]["day_cos"])
    far = abs(rows[2]["day_sin"] - rows[1]["day_sin"]) + abs(rows[2]["day_cos"] - rows[1]["day_cos"])
    assert near < 0.01 < far


def test_needs_timestamps(spark):
    with pytest.raises(TypeError):
        features.build(spark.createDataFrame([(1, 0, "a", "m", 1.0)], "timestamp int, pos long, service string, metric string, value double"), SMALL)


def test_windows_cost_one_layout_of_the_rows(spark):
    g = spark.createDataFrame([], "timestamp timestamp, pos long, service string, metric string, value double")
    for built in (features.build(g, SMALL), baselines.k_sigma_alerts(g), baselines.seasonal_naive(g, 24)):
        plan = built._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1
