"""What each kind of fault does to each metric, as a table and one formula over it.

At row ``i`` of a fault window of ``n`` rows and for a magnitude ``m`` a metric is multiplied by
``1 + gain * m * (max(s - offset, 0) / (1 - offset)) ** power``. The shape ``s`` climbs from 0 to 1 over the first
``ramp`` share of the window and then holds; where ``floor`` is below 1 it also decays towards it with a half-life of
``half_life`` windows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Kind, metric, ramp, floor, half_life, gain, power, offset.
EFFECTS = [
    ("cpu_saturation", "cpu_pct", 0.08, 1.0, 1.0, 2.6, 1.0, 0.0),
    ("cpu_saturation", "latency_p95_ms", 0.08, 1.0, 1.0, 2.0, 1.0, 0.0),
    ("cpu_saturation", "error_rate", 0.08, 1.0, 1.0, 4.0, 1.0, 0.6),
    ("memory_leak", "mem_mb", 1.0, 1.0, 1.0, 1.4, 1.0, 0.0),
    ("memory_leak", "latency_p95_ms", 1.0, 1.0, 1.0, 0.7, 3.0, 0.0),
    ("memory_leak", "cpu_pct", 1.0, 1.0, 1.0, 0.4, 2.0, 0.0),
    ("latency_injection", "latency_p95_ms", 0.02, 1.0, 1.0, 4.5, 1.0, 0.0),
    ("latency_injection", "error_rate", 0.02, 1.0, 1.0, 1.5, 1.0, 0.0),
    ("error_spike", "error_rate", 0.02, 0.45, 0.35, 70.0, 1.0, 0.0),
    ("error_spike", "latency_p95_ms", 0.02, 0.45, 0.35, 0.5, 1.0, 0.0),
    ("dependency_failure", "error_rate", 0.03, 1.0, 1.0, 90.0, 1.0, 0.0),
    ("dependency_failure", "latency_p95_ms", 0.03, 1.0, 1.0, 2.5, 1.0, 0.0),
    ("dependency_failure", "request_rate_rps", 0.03, 1.0, 1.0, -0.55, 1.0, 0.0),
    ("deploy_regression", "latency_p95_ms", 0.01, 1.0, 1.0, 0.85, 1.0, 0.0),
    ("deploy_regression", "cpu_pct", 0.01, 1.0, 1.0, 0.55, 1.0, 0.0),
]
KINDS = (
    "cpu_saturation",
    "memory_leak",
    "latency_injection",
    "error_spike",
    "dependency_failure",
    "deploy_regression",
)
PERMANENT_KIND = "deploy_regression"
PROPAGATING_METRICS = ("latency_p95_ms", "error_rate")

_SCHEMA = (
    "kind string, metric string, ramp double, floor double, half_life double, gain double, power double, offset double"
)


def effect_table(spark: SparkSession) -> DataFrame:
    """The table above with ``at_caller``: whether callers of the origin feel it too."""
    table = spark.createDataFrame(EFFECTS, _SCHEMA)
    return table.withColumn("at_caller", F.col("metric").isin(*PROPAGATING_METRICS))


def known_kind(kind: Column) -> Column:
    """The kind itself; an unknown one fails the job instead of being dropped by a join."""
    complaint = F.concat(F.lit("unknown fault kind: "), F.coalesce(kind, F.lit("none")))
    return F.when(kind.isin(*KINDS), kind).otherwise(F.raise_error(complaint).cast("string"))


def _field(name: str, of: Column | None) -> Column:
    return F.col(name) if of is None else of[name]


def ramp_steps(n: Column, of: Column | None = None) -> Column:
    """Rows until the shape has climbed to 1; halves are rounded to even.

    Here and below the parameters are columns of ``effect_table``, or fields of the struct ``of``.
    """
    return F.greatest(F.lit(1.0), F.rint(n * _field("ramp", of)))


def shape(i: Column, n: Column, of: Column | None = None) -> Column:
    floor = _field("floor", of)
    climb = F.least(i / ramp_steps(n, of), F.lit(1.0))
    decay = F.pow(F.lit(0.5), i / F.greatest(F.lit(1.0), n * _field("half_life", of)))
    return climb * (floor + (F.lit(1.0) - floor) * decay)


def moving_rows(n: Column) -> Column:
    """Rows after which the multiplier no longer changes; those of the whole window where it decays."""
    return F.when(F.col("floor") < 1.0, n).otherwise(F.least(n, ramp_steps(n).cast("long")))


def multiplier(i: Column, n: Column, magnitude: Column, of: Column | None = None) -> Column:
    """The factor at the origin."""
    offset = _field("offset", of)
    above = F.greatest(shape(i, n, of) - offset, F.lit(0.0)) / (F.lit(1.0) - offset)
    return F.lit(1.0) + _field("gain", of) * magnitude * F.pow(above, _field("power", of))


def inherited(factor: Column, hops: Column, attenuation: float) -> Column:
    """What is left of a factor some hops upstream; unchanged at the origin itself."""
    return F.lit(1.0) + (factor - F.lit(1.0)) * F.pow(F.lit(float(attenuation)), hops)
