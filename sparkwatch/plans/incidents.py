"""Reports on incidents and labelled runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sparkwatch import __version__
from sparkwatch.functions.percentiles import exact_percentiles
from sparkwatch.schema import SERIES

# Fixed value: the distance given to services that are not upstream of the origin.
UNRELATED = 99


def incident_summary(incidents: DataFrame) -> DataFrame:
    """Count and mean fan-out per kind, and over all (kind NULL)."""
    fan_out = F.avg(F.size("affected_services")).alias("mean_fan_out")
    return incidents.rollup("kind").agg(F.count(F.lit(1)).alias("incidents"), fan_out)


def summary_text(incidents: DataFrame) -> str:
    """The summary in one line."""
    rows = incident_summary(incidents).collect()  # one row per kind
    overall = next((r for r in rows if r["kind"] is None), None)
    if overall is None or overall["incidents"] == 0:
        return "no incidents"
    kinds = ", ".join(f"{r['kind']}: {r['incidents']}" for r in sorted(rows, key=lambda r: str(r["kind"])) if r["kind"])
    return f"{overall['incidents']} incidents, mean fan-out {overall['mean_fan_out']:.1f} services ({kinds})"


def run_manifest(labelled: DataFrame, incidents: DataFrame, step: Column | float) -> DataFrame:
    """One row describing a labelled run."""
    step = step if isinstance(step, Column) else F.lit(float(step))
    total = incidents.agg(F.count(F.lit(1)).alias("n")).scalar()
    return labelled.agg(
        F.min("timestamp").alias("start"),
        F.max("timestamp").alias("end"),
        F.count_distinct("service").alias("services"),
        F.count_distinct(*SERIES).alias("series"),
        F.count(F.lit(1)).alias("rows"),
        F.round(F.avg(F.col("is_anomalous").cast("double")), 6).alias("anomalous_fraction"),
    ).select(
        F.lit(__version__).alias("package_version"),
        "start",
        "end",
        step.alias("step_seconds"),
        "services",
        "series",
        "rows",
        total.alias("incidents"),
        "anomalous_fraction",
    )


def onset_order(labelled: DataFrame) -> DataFrame:
    """First anomalous time per incident and service: the order in which a cascade spreads."""
    return (
        labelled.where(F.col("is_anomalous"))
        .groupBy("incident_id", "service")
        .agg(F.min("timestamp").alias("onset"))
    )


def label_problems(labelled: DataFrame, incidents: DataFrame) -> DataFrame:
    """What does not add up between labels and incidents, one row per finding; empty when all is well."""
    used = labelled.where(F.col("incident_id") != "").select("incident_id", "service").distinct()
    known = incidents.select("incident_id", "root_service")
    ids = used.select("incident_id").distinct()
    findings = [
        (ids.join(known, "incident_id", "left_anti"), "label without incident"),
        (known.select("incident_id").distinct().join(ids, "incident_id", "left_anti"), "incident without label"),
        (
            known.withColumnRenamed("root_service", "service")
            .join(used, ["incident_id", "service"], "left_anti")
            .select("incident_id"),
            "root not marked",
        ),
    ]
    parts = [df.withColumn("problem", F.lit(text)) for df, text in findings]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def impact(
    telemetry: DataFrame,
    origin: str,
    hops: DataFrame,
    before: Column,
    after: Column,
) -> DataFrame:
    """Median CPU and p95 latency per service in two windows, with their distance from the origin.

    ``before`` and ``after`` are conditions on the telemetry rows. Services missing from either window are left out, and a
    zero latency before has no ratio.
    """
    side = F.when(before, F.lit("before")).when(after, F.lit("after"))
    sided = telemetry.where(F.col("metric").isin("cpu_pct", "latency_p95_ms")).withColumn("_side", side)
    medians = exact_percentiles(
        sided.where(F.col("_side").isNotNull()), ["service", "metric", "_side"], "value", [0.5], "_at"
    )

    def pick(metric: str, when: str) -> Column:
        return F.max(F.when((F.col("metric") == metric) & (F.col("_side") == when), F.col("_at")[0]))

    present = sided.where(F.col("_side").isNotNull()).select("service", "_side").distinct()
    seen = present.groupBy("service").agg(F.count(F.lit(1)).alias("_sides")).where(F.col("_sides") == 2)
    rows = (
        medians.groupBy("service")
        .agg(
            pick("cpu_pct", "before").alias("cpu_before"),
            pick("cpu_pct", "after").alias("cpu_after"),
            pick("latency_p95_ms", "before").alias("p95_before"),
            pick("latency_p95_ms", "after").alias("p95_after"),
        )
        .join(seen.select("service"), "service")
    )
    near = hops.where(F.col("origin") == origin).select("service", F.col("hops").alias("_hops"))
    distance = F.when(F.col("service") == origin, F.lit(0)).otherwise(F.coalesce("_hops", F.lit(UNRELATED)))
    ratio = F.try_divide(F.col("p95_after"), F.col("p95_before"))
    return (
        rows.join(near, "service", "left")
        .select("service", distance.alias("distance"), *[c for c in rows.columns if c != "service"], ratio.alias("p95_ratio"))
        .orderBy("distance", "service")
    )
