"""Shared schemas and the fixed vocabulary of telemetry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

# The five metric names and the physical bounds of each.
METRICS = ("request_rate_rps", "latency_p95_ms", "error_rate", "cpu_pct", "mem_mb")
UPPER_BOUNDS = {"error_rate": 1.0, "cpu_pct": 100.0}
LOWER_BOUND = 0.0

SERIES = ["service", "metric"]
CELL = ["timestamp", "service", "metric"]

TELEMETRY = T.StructType(
    [
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("service", T.StringType()),
        T.StructField("metric", T.StringType()),
        T.StructField("value", T.DoubleType()),
    ]
)

LABELLED = T.StructType(
    TELEMETRY.fields
    + [
        T.StructField("is_anomalous", T.BooleanType()),
        T.StructField("incident_id", T.StringType()),
    ]
)

INCIDENTS = T.StructType(
    [
        T.StructField("ordinal", T.LongType()),
        T.StructField("incident_id", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("root_service", T.StringType()),
        T.StructField("start", T.TimestampType()),
        T.StructField("end", T.TimestampType()),
        T.StructField("magnitude", T.DoubleType()),
        T.StructField("permanent", T.BooleanType()),
        T.StructField("affected_services", T.ArrayType(T.StringType())),
    ]
)

FAULTS = T.StructType(
    [
        T.StructField("ordinal", T.LongType()),
        T.StructField("kind", T.StringType()),
        T.StructField("service", T.StringType()),
        T.StructField("start", T.TimestampType()),
        T.StructField("duration_s", T.LongType()),
        T.StructField("magnitude", T.DoubleType()),
    ]
)


def missing_as_null(value: Column) -> Column:
    """NaN means "no sample"; Spark would treat it as a very large number."""
    return F.nanvl(value.cast("double"), F.lit(None).cast("double"))


def finite(value: Column) -> Column:
    """True only for a present, ordinary number."""
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) < F.lit(float("inf")))


def as_telemetry(df: DataFrame) -> DataFrame:
    """Cast any frame holding the four telemetry columns to the canonical types."""
    extra = [c for c in df.columns if c not in TELEMETRY.names]
    return df.select(
        F.col("timestamp").cast("timestamp").alias("timestamp"),
        F.col("service").cast("string").alias("service"),
        F.col("metric").cast("string").alias("metric"),
        missing_as_null(F.col("value")).alias("value"),
        *extra,
    )


def within_bounds(metric: Column, value: Column) -> Column:
    """Clip a value to what its metric can physically be; missing stays missing."""
    upper = F.lit(float("inf"))
    for name, top in UPPER_BOUNDS.items():
        upper = F.when(metric == name, F.lit(top)).otherwise(upper)
    return F.when(value.isNotNull(), F.greatest(F.lit(LOWER_BOUND), F.least(upper, value)))
