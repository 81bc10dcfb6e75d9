"""Telemetry from files: labelled runs and landed range-query responses."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, StructType

from sparkwatch.schema import INCIDENTS, LABELLED, as_telemetry, missing_as_null

# The part of a range-query response that is read.
RESPONSE = (
    "status string, error string, "
    "data struct<result: array<struct<metric: map<string, string>, values: array<array<string>>>>>"
)


def _csv_by_name(spark: SparkSession, path: str, schema: StructType, optional: Iterable[str] = ()) -> DataFrame:
    """Columns of CSV files by the names in their header, in any order, cast to ``schema``.

    A column that is unknown, or missing and not ``optional``, is an error. A field that is not a value of its type is one when it is
    read, rather than NULL. Lists stay strings.
    """
    raw = spark.read.option("header", True).option("inferSchema", False).option("enforceSchema", False).csv(path)
    known = {f.name: f.dataType for f in schema}
    unknown = sorted(set(raw.columns) - set(known))
    missing = sorted(set(known) - set(raw.columns) - set(optional))
    if unknown or missing:
        raise ValueError(f"{path}: unknown columns {unknown}, missing columns {missing}")
    return raw.select(*[F.col(n).cast("string" if isinstance(t, ArrayType) else t).alias(n) for n, t in known.items() if n in raw.columns])


def read_labelled_csv(spark: SparkSession, path: str, metrics: Iterable[str] | None = None) -> DataFrame:
    """A labelled run from (gzipped) CSV. One gzip file is one task: keep runs in many files, or in Parquet."""
    rows = _csv_by_name(spark, path, LABELLED)
    rows = rows.withColumn("incident_id", F.coalesce("incident_id", F.lit("")))
    return only_metrics(as_telemetry(rows), metrics)


def read_telemetry(spark: SparkSession, path: str, metrics: Iterable[str] | None = None) -> DataFrame:
    """Telemetry from Parquet; the metric choice prunes partitions or row groups."""
    return as_telemetry(only_metrics(spark.read.parquet(path), metrics))


def read_incidents_csv(spark: SparkSession, path: str) -> DataFrame:
    """An incident table with comma-joined services, back to lists.

    Without an ``ordinal`` column the number in the incident's id is its place. Runs of a live mesh have no magnitude and no
    permanent incidents: those columns may be left out too.
    """
    flat = _csv_by_name(spark, path, INCIDENTS, optional=("ordinal", "magnitude", "permanent"))
    parts = F.filter(F.split(F.coalesce("affected_services", F.lit("")), ","), lambda s: s != "")
    flat = flat.withColumn("affected_services", parts)
    number = F.regexp_extract("incident_id", "^INC-([0-9]+)$", 1)
    defaults = {"ordinal": number.cast("long"), "magnitude": F.lit(None).cast("double"), "permanent": F.lit(False)}
    return flat.withColumns({n: c for n, c in defaults.items() if n not in flat.columns}).select(*INCIDENTS.names)


def only_metrics(telemetry: DataFrame, metrics: Iterable[str] | None) -> DataFrame:
    return telemetry if metrics is None else telemetry.where(F.col("metric").isin(*metrics))


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """Landed responses, one whole JSON document per file, with the metric named by the ``metric=`` folder."""
    return spark.read.option("wholetext", True).option("basePath", path).text(path).withColumnRenamed("value", "payload")


def parse_responses(responses: DataFrame) -> DataFrame:
    return responses.withColumn("_r", F.from_json("payload", RESPONSE))


def rejected(responses: DataFrame) -> DataFrame:
    """Failed responses with their error text."""
    parsed = parse_responses(responses)
    ok = F.coalesce(F.col("_r.status") == "success", F.lit(False))
    return parsed.where(~ok).select("metric", F.coalesce("_r.error", F.lit("query failed")).alias("error"))


def responses_to_telemetry(responses: DataFrame, metrics: Iterable[str] | None = None, strict: bool = False) -> DataFrame:
    """Rows (metric, payload) to telemetry; series without a service label are dropped.

    Failed responses are left to ``rejected``, or fail the job when ``strict``. "NaN" becomes NULL.
    """
    parsed = parse_responses(only_metrics(responses, metrics))
    ok = F.coalesce(F.col("_r.status") == "success", F.lit(False))
    if strict:
        message = F.coalesce("_r.error", F.lit("query failed"))
        parsed = parsed.where(F.when(ok, F.lit(True)).otherwise(F.raise_error(message).cast("boolean")))
    series = parsed.where(ok).select("metric", F.explode("_r.data.result").alias("_s"))
    service = F.col("_s.metric")["service"]
    points = series.where(F.coalesce(service, F.lit("")) != "").select(
        service.alias("service"), "metric", F.explode("_s.values").alias("_p")
    )
    micros = F.round(F.col("_p")[0].cast("double") * F.lit(1e6)).cast("long")
    return points.select(
        F.timestamp_micros(micros).alias("timestamp"), "service", "metric", missing_as_null(F.col("_p")[1]).alias("value")
    )


def in_order(telemetry: DataFrame) -> DataFrame:
    """Sorted for export; a range-partitioned sort."""
    return telemetry.orderBy("timestamp", "service", "metric")
