"""The overlay against a plain NumPy reading of its rules."""

import numpy as np
import pandas as pd
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from helpers import column, same, sparse_grid, telemetry, times
from sparkwatch.functions.profiles import EFFECTS, KINDS, effect_table, multiplier
from sparkwatch.operators import grid, overlay
from sparkwatch.operators.grid import axis_of, cells, dense, indexed
from sparkwatch.schema import METRICS

N = 400
FAULTS = "ordinal long, kind string, service string, start timestamp, duration_s long, magnitude double"


def profile(kind, metric, n, m):
    """Row by row, from the description of the table."""
    for k, name, ramp, floor, half, gain, power, offset in EFFECTS:
        if (k, name) == (kind, metric):
            i = np.arange(n, dtype=float)
            s = np.minimum(i / max(1, int(round(n * ramp))), 1.0)
            s = s * (floor + (1 - floor) * 0.5 ** (i / max(1.0, n * half)))
            return 1 + gain * m * (np.maximum(s - offset, 0) / (1 - offset)) ** power
    return None


def healthy(spark):
    base = {"request_rate_rps": 40.0, "latency_p95_ms": 45.0, "error_rate": 0.002, "cpu_pct": 25.0, "mem_mb": 512.0}
    return indexed(cells(telemetry(spark, {(s, m): [base[m]] * N for s in ("a", "b", "c", "x") for m in METRICS}, 15))), base


def hops(spark):
    return spark.createDataFrame([("c", "b", 1), ("c", "a", 2), ("b", "a", 1)], "origin string, service string, hops int")


def faults(spark, *rows):
    at = times(N, 15)
    return spark.createDataFrame(
        [(i, k, s, at[p].to_pydatetime(), int(d * 15), float(m)) for i, (k, s, p, d, m) in enumerate(rows)], FAULTS
    )


def by_hand(rows, base):
    upstream = {"c": {"b": 1, "a": 2}, "b": {"a": 1}, "a": {}, "x": {}}
    values = {(s, m): np.full(N, base[m]) for s in ("a", "b", "c", "x") for m in METRICS}
    owner = {key: np.full(N, "", dtype=object) for key in values}
    for number, (kind, service, start, rows_, m) in enumerate(rows):
        n = N - start if kind == "deploy_regression" else min(rows_, N - start)
        for target, distance in {service: 0, **upstream[service]}.items():
            for metric in METRICS:
                shape = profile(kind, metric, n, m)
                if shape is None or (distance and metric not in ("latency_p95_ms", "error_rate")):
                    continue
                factor = np.ones(N)
                factor[start : start + n] = shape
                delay = 4 * distance
                factor = np.concatenate([np.ones(delay), factor])[:N]
                factor = 1 + (factor - 1) * 0.55**distance
                if distance and np.abs(factor - 1).max() <= 0.05:
                    continue
                values[target, metric] = values[target, metric] * factor
                active = np.abs(factor - 1) > 0.05
                free = active & (owner[target, metric] == "")
                owner[target, metric][free] = f"INC-{number:04d}"
    top = {"error_rate": 1.0, "cpu_pct": 100.0}
    return {k: np.clip(v, 0, top.get(k[1], np.inf)) for k, v in values.items()}, owner


CASES = [
    [(k, "c", 100, 120, 0.8)] for k in KINDS
] + [
    [("latency_injection", "c", 390, 60, 1.0)],
    [("error_spike", "b", 10, 2, 0.9), ("memory_leak", "b", 10, 3, 0.04)],
    [("latency_injection", "c", 50, 200, 0.5), ("dependency_failure", "b", 120, 90, 1.0), ("deploy_regression", "c", 200, 5, 0.7)],
]


@pytest.mark.parametrize("rows", CASES, ids=lambda r: "+".join(k for k, *_ in r))
def test_overlay_matches_the_rules(spark, rows):
    g, base = healthy(spark)
    table = faults(spark, *rows)
    values, owner = by_hand(rows, base)
    got = overlay.apply_faults(g, overlay.effects(table, axis_of(g), hops(spark))).toPandas().sort_values("pos")
    for (service, metric), want in values.items():
        part = got[(got.service == service) & (got.metric == metric)]
        same(list(part["value"]), list(want), 1e-9)
        assert list(part["incident_id"]) == list(owner[service, metric])
        assert list(part["is_anomalous"]) == [o != "" for o in owner[service, metric]]
    records = {r["ordinal"]: r for r in overlay.incident_records(table, g, hops(spark)).collect()}
    if len(rows) == 1:
        assert records[0]["affected_services"] == sorted({s for (s, _), o in owner.items() if (o != "").any()})
    last = times(N, 15)[-1].to_pydatetime().replace(tzinfo=None)
    for number, (kind, *_) in enumerate(rows):
        assert records[number]["permanent"] == (kind == "deploy_regression")
        if kind == "deploy_regression":
            assert records[number]["end"] == last


def test_peak_is_found_without_spelling_the_profile_out(spark):
    sizes = spark.createDataFrame([(n, cut) for n in (1, 2, 3, 7, 49, 50, 51, 400) for cut in (1, 2, 5, 40, 400)], "n long, cut long")
    rows = sizes.join(effect_table(spark)).withColumn("length", F.least("n", "cut")).withColumn("m", F.lit(0.7))
    i = F.least(overlay.ramp_steps(F.col("n")), (F.col("length") - 1).cast("double"))
    for r in rows.withColumn("peak", F.abs(multiplier(i, F.col("n"), F.col("m")) - 1)).collect():
        want = np.abs(profile(r["kind"], r["metric"], r["n"], 0.7)[: r["length"]] - 1).max()
        assert r["peak"] == pytest.approx(want, abs=1e-12), r


def test_no_faults_change_nothing(spark):
    g, _ = healthy(spark)
    got = overlay.apply_faults(g, overlay.effects(faults(spark, *CASES[0]).limit(0), axis_of(g), hops(spark)))
    assert got.where("is_anomalous or incident_id <> ''").count() == 0
    assert got.select(*g.columns).exceptAll(g).count() == 0


def test_missing_cells_stay_missing(spark):
    g = dense(sparse_grid(spark, {("c", "cpu_pct"): [1.0, np.nan, 1.0, 1.0], ("x", "cpu_pct"): [1.0] * 4}, 15))
    got = overlay.apply_faults(g, overlay.effects(faults(spark, ("cpu_saturation", "c", 0, 4, 1.0)), axis_of(g), hops(spark)))
    assert column(got, "value", "c", "cpu_pct")[1] is None


@pytest.mark.parametrize("magnitude,duration", [(1.5, 10), (0.0, 10), (0.5, 0)])
def test_invalid_faults(spark, magnitude, duration):
    table = faults(spark, ("error_spike", "c", 0, duration, magnitude))
    assert overlay.problems(table).count() == 1
    with pytest.raises(PySparkException, match="magnitude|duration"):
        overlay.checked(table).collect()
