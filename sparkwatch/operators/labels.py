"""Mark telemetry from a table of incidents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sparkwatch.functions.profiles import effect_table, known_kind
from sparkwatch.operators.grid import positions_of
from sparkwatch.operators.intervals import settle
from sparkwatch.schema import SERIES
from sparkwatch.session import stored

_BUCKET_SECONDS = 6 * 3600


def service_list(column: Column, is_text: bool) -> Column:
    """A list of services, from a list or from comma-joined text (empty parts dropped)."""
    return F.filter(F.split(column, ","), lambda s: s != "") if is_text else column


def claims(incidents: DataFrame, affected: str = "affected_services") -> DataFrame:
    """Per incident the series it disturbs: all metrics of its kind at the root, the
    propagating ones at the other affected services."""
    is_text = incidents.schema[affected].dataType.simpleString() == "string"
    root = F.col("root_service")
    others = F.filter(service_list(F.col(affected), is_text), lambda s: s != root)
    touched = incidents.withColumn("kind", known_kind(F.col("kind"))).select(
        "ordinal",
        "incident_id",
        "kind",
        "start",
        "end",
        "root_service",
        F.explode(F.concat(F.array(root), F.coalesce(others, F.array().cast("array<string>")))).alias("service"),
    )
    # fifteen fixed rows
    kinds = F.broadcast(effect_table(incidents.sparkSession).select("kind", "metric", "at_caller"))
    return (
        touched.join(kinds, "kind")
        .where((F.col("service") == root) | F.col("at_caller"))
        .select("ordinal", "incident_id", "service", "metric", "start", "end")
        .distinct()
    )


def label(
    telemetry: DataFrame,
    incidents: DataFrame,
    affected: str = "affected_services",
    bucket_seconds: int = _BUCKET_SECONDS,
) -> DataFrame:
    """Telemetry with ``is_anomalous`` and ``incident_id`` ("" for none); both window ends count.

    Of several incidents on a cell the one with the lowest ``ordinal`` keeps it. Incidents between two times of the telemetry are out before
    they are spelled out by service and metric. Claims are settled among themselves first: every stretch of a
    series' time belongs to one claim or none. Stretches are clipped to the time that telemetry covers, cut into time buckets, and a row of
    telemetry meets at most one of them, so telemetry is shuffled once (or not at all while the stretches are few). A claim may end in 9999.
    """
    owned = _owned(claims(_touching(telemetry, incidents), affected))
    bounds = telemetry.agg(F.min("timestamp").alias("lo"), F.max("timestamp").alias("hi"))
    ends = bounds.select(F.struct(F.unix_micros("lo").alias("lo"), F.unix_micros("hi").alias("hi"))).scalar()
    width = bucket_seconds * 1_000_000
    clipped = owned.withColumns({"_from": F.greatest("_from", ends["lo"]), "_until": F.least("_until", ends["hi"] + 1)}).where("_from < _until")
    buckets = F.sequence(F.expr(f"floor(_from / {width})"), F.expr(f"floor((_until - 1) / {width})"))
    cut = clipped.select(*SERIES, "_from", "_until", "_claim", F.explode(buckets).alias("_bucket"))
    at = F.unix_micros("timestamp")
    asked = telemetry.withColumns({"_at": at, "_bucket": F.floor(at / width)}).alias("t")
    same = [F.col(f"t.{c}") == F.col(f"c.{c}") for c in [*SERIES, "_bucket"]]
    inside = (F.col("t._at") >= F.col("c._from")) & (F.col("t._at") < F.col("c._until"))
    found = asked.join(cut.alias("c"), [*same, inside], "left")
    return found.select(
        *[F.col(f"t.{c}") for c in telemetry.columns],
        F.col("c._claim").isNotNull().alias("is_anomalous"),
        F.coalesce("c._claim.incident_id", F.lit("")).alias("incident_id"),
    )


def _touching(telemetry: DataFrame, incidents: DataFrame) -> DataFrame:
    """The incidents during which telemetry has a timestamp, both ends included."""
    axis = telemetry.select("timestamp").where(F.col("timestamp").isNotNull()).distinct()
    # the end counts
    after = F.timestamp_micros(F.unix_micros("end") + 1)
    ends = incidents.select(F.col("start").alias("timestamp")).unionByName(incidents.select(after.alias("timestamp")))
    placed = stored(positions_of(axis, ends.where(F.col("timestamp").isNotNull())))
    first = placed.select(F.col("timestamp").alias("_start"), F.col("before").alias("_first"))
    last = placed.select(F.col("timestamp").alias("_after"), F.col("before").alias("_last"))
    rows = incidents.withColumn("_end", after).join(first, F.col("start") == F.col("_start")).join(last, F.col("_end") == F.col("_after"))
    return rows.where("_first < _last").select(*incidents.columns)


def _owned(claimed: DataFrame) -> DataFrame:
    """Disjoint stretches of microseconds per series, ``_from`` to before ``_until``, with the claim of the lowest ordinal."""
    rows = claimed.select(
        *SERIES,
        F.unix_micros("start").alias("_from"),
        # the end counts
        (F.unix_micros("end") + 1).alias("_until"),
        F.struct("ordinal", "incident_id").alias("_claim"),
    )
    return settle(rows, SERIES, "_from", "_until", {"_claim": F.min})
