"""Labelled runs to files: telemetry, incidents, manifest."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from sparkwatch.schema import INCIDENTS

# Whole microseconds; Spark's default for CSV keeps milliseconds only.
_TIMES = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"


def write_labelled_csv(telemetry: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Gzipped CSV, one file per partition."""
    telemetry.write.mode(mode).option("header", True).option("timestampFormat", _TIMES).option("compression", "gzip").csv(path)


def write_telemetry(telemetry: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Parquet by metric and day, so that both kinds of filter prune files.

    Rows are gathered per folder first, which keeps the number of files small; the rebalance hint lets Spark split
    a folder that is too large for one writer.
    """
    dated = telemetry.withColumn("day", F.to_date("timestamp"))
    dated.hint("rebalance", "metric", "day").write.mode(mode).partitionBy("metric", "day").parquet(path)


def flat_incidents(incidents: DataFrame) -> DataFrame:
    """Incidents with their services comma-joined, the form CSV can hold."""
    return incidents.withColumn("affected_services", F.array_join("affected_services", ","))


def write_incidents_csv(incidents: DataFrame, path: str, mode: str = "errorifexists") -> None:
    flat_incidents(incidents).select(*INCIDENTS.names).write.mode(mode).option("header", True).option("timestampFormat", _TIMES).csv(path)


def write_manifest(manifest: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """The one-row manifest as JSON."""
    manifest.coalesce(1).write.mode(mode).json(path)
