"""How the given tables stand in for telemetry, call graphs, counters and incidents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from sparkwatch.functions.percentiles import exact_percentiles
from sparkwatch.functions.profiles import KINDS, PERMANENT_KIND
from sparkwatch.operators import graph, labels, overlay
from sparkwatch.operators.features import FeatureSpec
from sparkwatch.operators.grid import cells, clean_cells, indexed
from sparkwatch.operators.scrape import LATENCY_BOUNDS
from sparkwatch.plans.forecasting import ForecastPlan
from sparkwatch.session import stored, use_utc

HOUR = 3600
DAY = 24
SPEC = FeatureSpec(day=DAY, windows=(24, 72))
WINDOW = 48
#: Services of a group of users; a group is so many consecutive numbers, so services and series grow with the users.
SERVICES, USERS = 6, 1500
GAUGES = ("request_rate_rps", "latency_p95_ms", "error_rate", "cpu_pct", "mem_mb")


def events(spark: SparkSession, sf: str) -> DataFrame:
    """Single events; each counts as one request to the service of its user."""
    use_utc(spark)
    raw = spark.read.parquet(f"{sf}/events.parquet")
    return raw.select(
        "event_id",
        F.col("ts").cast("timestamp").alias("timestamp"),
        _service(F.col("user_id") % SERVICES).alias("service"),
        "user_id",
        "event_type",
        "value",
        "props",
    )


def _service(nth: Column) -> Column:
    """The name of the nth service of a user's group."""
    return F.concat(F.lit("s"), F.expr(f"user_id div {USERS}") * SERVICES + nth)


def series() -> list[str]:
    """Names of the series of the first group's services."""
    return [f"s{i}/{m}" for i in range(SERVICES) for m in GAUGES]


def hourly(rows: DataFrame) -> DataFrame:
    return rows.withColumn("timestamp", F.date_trunc("hour", "timestamp"))


def telemetry(spark: SparkSession, sf: str) -> DataFrame:
    """Long telemetry: five metrics per service and hour."""
    rows = hourly(events(spark, sf))
    by = ["timestamp", "service"]
    aggregates = [
        (F.count(F.lit(1)) / F.lit(float(HOUR))).alias("request_rate_rps"),
        F.avg((F.col("event_type") == "error").cast("double")).alias("error_rate"),
        F.least(F.avg("value"), F.lit(100.0)).alias("cpu_pct"),
        F.max("value").alias("mem_mb"),
    ]
    slow = exact_percentiles(rows, by, "value", [0.95], "_at").select(*by, F.col("_at")[0].alias("latency_p95_ms"))
    per_hour = rows.groupBy(*by).agg(*aggregates).join(slow, by, "left")
    return per_hour.unpivot(by, list(GAUGES), "metric", "value")


def observed(spark: SparkSession, sf: str) -> DataFrame:
    """Which cells of the grid have a value, without the values."""
    per_hour = hourly(events(spark, sf)).groupBy("timestamp", "service").agg(F.count("value").alias("_n"))
    always = [m for m in GAUGES if m in ("request_rate_rps", "error_rate")]
    metrics = F.when(F.col("_n") > 0, F.array(*[F.lit(m) for m in GAUGES])).otherwise(F.array(*[F.lit(m) for m in always]))
    return stored(indexed(per_hour.select("timestamp", "service", F.explode(metrics).alias("metric"))))


def sparse(spark: SparkSession, sf: str) -> DataFrame:
    """The sparse grid, written once per query that uses it."""
    return stored(indexed(cells(telemetry(spark, sf))))


def forecast_plan(spark: SparkSession, sf: str, **changes) -> ForecastPlan:
    """Reports have rows of every series, as their SQL has; faults grow with the events and may leave a series few clean hours, or none."""
    return ForecastPlan(day=DAY, short="warn", **changes)


# --- call graph -----------------------------------------------------------------------------


def calls(spark: SparkSession, sf: str) -> DataFrame:
    """Each event as a call from its service to one of the next two of its group."""
    number = F.col("user_id") % SERVICES
    callee = F.least(F.lit(SERVICES - 1), number + 1 + F.col("event_id") % 2)
    rows = events(spark, sf).select(F.col("service").alias("caller"), _service(callee).alias("callee"))
    return rows.where(F.col("caller") != F.col("callee"))


def services(spark: SparkSession, sf: str) -> DataFrame:
    """Service table with ``depends_on``; a service's list is as long as its distinct callees."""
    links = calls(spark, sf).distinct()
    named = events(spark, sf).select(F.col("service").alias("name")).distinct()
    lists = links.groupBy(F.col("caller").alias("name")).agg(F.array_sort(F.collect_list("callee")).alias("depends_on"))
    empty = F.array().cast("array<string>")
    return named.join(lists, "name", "left").withColumn("depends_on", F.coalesce("depends_on", empty))


def user_calls(spark: SparkSession, sf: str) -> DataFrame:
    """A deeper graph whose size follows the data: each user calls the users with half and a third of their number."""
    user = F.col("user_id")
    callee = F.explode(F.array(F.floor(user / 2), F.floor(user / 3)))
    rows = events(spark, sf).select(user.alias("_user"), callee.alias("_callee")).where(F.col("_user") != F.col("_callee"))
    name = [F.concat(F.lit("u"), F.col(c)).alias(n) for c, n in (("_user", "caller"), ("_callee", "callee"))]
    return rows.select(*name).distinct()


def hops(spark: SparkSession, sf: str) -> DataFrame:
    """Upstream distances of the service graph."""
    return graph.upstream_hops(calls(spark, sf))


def radius(spark: SparkSession, sf: str) -> DataFrame:
    named = events(spark, sf).select(F.col("service").alias("name")).distinct()
    return graph.blast_radius(named, hops(spark, sf))


# --- incidents and faults -------------------------------------------------------------------


def faults(spark: SparkSession, sf: str) -> DataFrame:
    """Every error event as a fault: the worst of a day lasts eight hours and may be of any kind, the others last one to three minutes and
    end by themselves. Ordinals are the events' numbers, which follow time."""
    errors = events(spark, sf).where(F.col("event_type") == "error").withColumn("_day", F.to_date("timestamp"))
    best = F.max(F.struct(F.col("value"), (-F.col("event_id")).alias("_neg"))).alias("_e")
    worst = errors.groupBy("_day").agg(best).select("_day", (-F.col("_e._neg")).alias("_worst"))
    rows = errors.join(worst, "_day").withColumn("_long", F.col("event_id") == F.col("_worst"))
    kinds = F.array(*[F.lit(k) for k in KINDS])
    passing = len(KINDS) - 1  # the last kind never ends
    kind = F.get(kinds, F.when(F.col("_long"), F.dayofmonth("timestamp") % len(KINDS)).otherwise(F.col("event_id") % passing).cast("int"))
    table = rows.select(
        F.col("event_id").alias("ordinal"),
        kind.alias("kind"),
        "service",
        F.col("timestamp").alias("start"),
        F.when(F.col("_long"), F.lit(8 * HOUR)).otherwise(60 * (1 + F.col("event_id") % 3)).cast("long").alias("duration_s"),
        (F.lit(0.35) + (F.col("event_id") % 66) / F.lit(100.0)).alias("magnitude"),
    )
    return stored(table)


def fault_users(spark: SparkSession, sf: str) -> DataFrame:
    """The users with an error, as names of the deeper call graph."""
    errors = events(spark, sf).where(F.col("event_type") == "error")
    return errors.select(F.concat(F.lit("u"), F.col("user_id")).alias("origin")).distinct()


def incidents(spark: SparkSession, sf: str) -> DataFrame:
    """The same events as a written incident table with blast radii."""
    end = F.timestamp_micros(F.unix_micros("start") + F.col("duration_s") * 1_000_000)
    rows = faults(spark, sf).select(
        "ordinal",
        overlay.incident_id(F.col("ordinal")).alias("incident_id"),
        "kind",
        F.col("service").alias("root_service"),
        "start",
        end.alias("end"),
        "magnitude",
        (F.col("kind") == PERMANENT_KIND).alias("permanent"),
    )
    reach = radius(spark, sf).withColumnRenamed("root", "root_service")
    return stored(rows.join(reach, "root_service").select(*rows.columns, "affected_services"))


def labelled(spark: SparkSession, sf: str, known: DataFrame | None = None, seen: DataFrame | None = None) -> DataFrame:
    """Telemetry with labels; ``known`` and ``seen`` are the incidents and the telemetry where the caller has written them already."""
    seen = stored(telemetry(spark, sf)) if seen is None else seen
    return labels.label(seen, incidents(spark, sf) if known is None else known)


def clean_grid(spark: SparkSession, sf: str) -> DataFrame:
    """The sparse grid with ``clean``. All rows of a cell carry the same label here."""
    marked = labelled(spark, sf).where(F.col("value").isNotNull())
    return stored(indexed(clean_cells(marked, ["incident_id"])))


# --- scraped samples ------------------------------------------------------------------------


def request_counters(spark: SparkSession, sf: str) -> DataFrame:
    """Hourly scrapes of request counters by service and status that restart at midnight."""
    status = F.when(F.col("event_type") == "error", F.lit("500")).otherwise(F.lit("200"))
    counts = (
        hourly(events(spark, sf))
        .groupBy("timestamp", "service", status.alias("status"))
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    # at most 24 rows per partition
    day = Window.partitionBy("service", "status", F.to_date("timestamp")).orderBy("timestamp")
    return counts.select("timestamp", "service", "status", F.sum("_n").over(day).cast("double").alias("value"))


def duration_buckets(spark: SparkSession, sf: str) -> DataFrame:
    """Hourly cumulative bucket rates of event values, taken as hundredths of a second."""
    bounds = F.array(*[F.lit(float(b)) for b in (*LATENCY_BOUNDS, float("inf"))])
    seconds = F.col("value") / F.lit(100.0)
    rows = hourly(events(spark, sf)).where(F.col("value").isNotNull())
    reached = rows.select("timestamp", "service", seconds.alias("_s"), F.explode(bounds).alias("le"))
    held = F.sum((F.col("_s") <= F.col("le")).cast("double")) / F.lit(float(HOUR))
    return reached.groupBy("timestamp", "service", "le").agg(held.alias("value"))


def responses(spark: SparkSession, sf: str) -> DataFrame:
    """Telemetry as range-query responses, one per series and day."""
    point = F.concat(
        F.lit("["), F.unix_seconds("timestamp").cast("string"), F.lit(',"'), F.col("value").cast("string"), F.lit('"]')
    )
    rows = telemetry(spark, sf).where(F.col("value").isNotNull())
    # at most 24 points per list
    per_day = rows.groupBy("metric", "service", F.to_date("timestamp").alias("_day")).agg(
        F.array_join(F.collect_list(point), ",").alias("_points")
    )
    body = F.concat(
        F.lit('{"status":"success","data":{"resultType":"matrix","result":[{"metric":{"service":"'),
        F.col("service"),
        F.lit('"},"values":['),
        F.col("_points"),
        F.lit("]}]}}"),
    )
    return per_day.select("metric", body.alias("payload"))
