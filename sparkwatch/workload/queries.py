"""One function per registered query: (spark, folder of the tables) -> DataFrame."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sparkwatch.functions.ladder import LEVELS, covered, monotone, pinball, pit
from sparkwatch.functions.profiles import effect_table, multiplier
from sparkwatch.operators import baselines, evaluate, features, forecast, graph, grid, labels, overlay, scrape
from sparkwatch.operators.boosting import BoostConfig
from sparkwatch.plans import alerting, forecasting, incidents as incident_plans
from sparkwatch.schema import CELL, SERIES, within_bounds
from sparkwatch.session import shared_folder, stored
from sparkwatch.sources import readers, writers
from sparkwatch.workload import tables as t

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
STEP = float(t.HOUR)
RUNGS = [f"q{round(p * 100):02d}" for p in LEVELS]


def shown(df: DataFrame, digits: int = 6) -> DataFrame:
    """Results in types both engines print alike: rounded doubles, plain timestamps, long integers.

    A billionth is added before rounding, since engines disagree on which way an exact half goes.
    """
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        kind = f.dataType.simpleString()
        if kind == "double":
            c = F.round(c + F.lit(1e-9), digits)
        elif kind == "timestamp":
            c = c.cast("timestamp_ntz")
        elif kind == "int":
            c = c.cast("long")
        elif kind == "array<string>":
            c = F.array_join(c, ",")
        out.append(c.alias(f.name))
    return df.select(*out)


def query(fn: Query) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        return shown(fn(spark, sf))

    QUERIES[fn.__name__] = run
    return fn


def rungs(ladder: str, names: list[str] = RUNGS) -> list[Column]:
    return [F.get(ladder, F.lit(i)).alias(n) for i, n in enumerate(names)]


# --- sources and sinks ----------------------------------------------------------------------


@query
def prom_matrix_to_long(spark, sf):
    return readers.responses_to_telemetry(t.responses(spark, sf))


@query
def incidents_flat(spark, sf):
    return writers.flat_incidents(t.incidents(spark, sf))


# --- scraped samples ------------------------------------------------------------------------


@query
def request_rate(spark, sf):
    counters = t.request_counters(spark, sf)
    return scrape.rate(counters, ["service", "status"], ["service"], 2 * t.HOUR, t.HOUR)


@query
def event_rate(spark, sf):
    return scrape.event_rate(t.events(spark, sf), ["service"], t.HOUR)


@query
def error_ratio(spark, sf):
    counters = t.request_counters(spark, sf)
    return scrape.error_ratio(scrape.rate(counters, ["service", "status"], ["service", "status"], 2 * t.HOUR, t.HOUR))


@query
def latency_p95_hist(spark, sf):
    return scrape.latency_p95_ms(t.duration_buckets(spark, sf))


@query
def latency_p95_exact(spark, sf):
    rows = t.hourly(t.events(spark, sf))
    return scrape.raw_percentile(rows, ["timestamp", "service"])


@query
def gauge_last(spark, sf):
    return scrape.last_per_step(t.events(spark, sf), ["service"], t.HOUR, t.HOUR)


@query
def grid_resample(spark, sf):
    samples = t.events(spark, sf)
    first = F.date_trunc("hour", F.min("timestamp")) + F.expr("INTERVAL 30 MINUTES")
    start, end = samples.agg(first.cast("string"), F.max("timestamp").cast("string")).first()
    return scrape.resample(samples, ["service"], start, end, 900, 2 * t.HOUR)


def _folder(spark) -> str:
    return f"{shared_folder(spark)}/{uuid.uuid4().hex}"


@query
def run_csv_round_trip(spark, sf):
    path = _folder(spark)
    writers.write_labelled_csv(t.labelled(spark, sf), path)
    return readers.read_labelled_csv(spark, path)


@query
def incidents_csv_round_trip(spark, sf):
    path = _folder(spark)
    writers.write_incidents_csv(t.incidents(spark, sf), path)
    return readers.read_incidents_csv(spark, path)


@query
def manifest_json_round_trip(spark, sf):
    path, manifest = _folder(spark), _manifest(spark, sf)
    writers.write_manifest(manifest, path)
    return spark.read.schema(manifest.schema).json(path)


@query
def metric_subset(spark, sf):
    path = _folder(spark)
    writers.write_telemetry(t.telemetry(spark, sf), path)
    return readers.read_telemetry(spark, path, metrics=["cpu_pct", "mem_mb"]).select(*CELL, "value")


@query
def rejected_responses(spark, sf):
    failed = F.when(F.col("metric") == "mem_mb", '{"status":"error","error":"too many samples"}').when(F.col("metric") == "error_rate", "{}")
    pages = t.responses(spark, sf).withColumn("payload", F.coalesce(failed, F.col("payload")))
    return readers.rejected(pages).groupBy("metric", "error").agg(F.count(F.lit(1)).alias("responses"))


@query
def service_filter(spark, sf):
    plan = t.forecast_plan(spark, sf, services=("s1", "s4"))
    rows = forecasting.predictions(t.clean_grid(spark, sf), plan)
    return rows.select(*CELL, "value", *rungs("q"))


# --- shaping --------------------------------------------------------------------------------


@query
def grid_dense(spark, sf):
    return grid.dense(t.sparse(spark, sf))


@query
def wide_pivot(spark, sf):
    return grid.wide(t.telemetry(spark, sf), t.series())


@query
def wide_unpivot(spark, sf):
    return grid.unpivot(grid.wide(t.telemetry(spark, sf), t.series()))


@query
def step_seconds(spark, sf):
    return grid.step_seconds(t.sparse(spark, sf))


@query
def clean_mask(spark, sf):
    rows = t.hourly(t.events(spark, sf)).select(
        "timestamp",
        "service",
        F.lit("event_value").alias("metric"),
        "value",
        (F.col("event_type") == "error").alias("is_anomalous"),
        "event_id",
    )
    return grid.clean_cells(rows, ["event_id"])


@query
def chrono_split(spark, sf):
    seen = t.sparse(spark, sf)
    parts = grid.split(seen, 0.7)
    named = [p.withColumn("part", F.lit(n)) for p, n in zip(parts, ("train", "test"))]
    return (
        named[0]
        .unionByName(named[1])
        .groupBy("part", *SERIES)
        .agg(F.count(F.lit(1)).alias("cells"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last"))
    )


@query
def residuals(spark, sf):
    predicted = baselines.seasonal_naive(grid.dense(t.sparse(spark, sf)), t.DAY)
    return grid.residuals(predicted).select(*CELL, "value", "predicted", "residual")


@query
def clip_bounds(spark, sf):
    rows = t.telemetry(spark, sf)
    moved = F.col("value") * 2 - F.when(F.col("metric") == "error_rate", F.lit(0.5)).otherwise(F.lit(20.0))
    return rows.select(*CELL, within_bounds(F.col("metric"), moved).alias("value"))


# --- baselines ------------------------------------------------------------------------------


@query
def seasonal_naive(spark, sf):
    return baselines.seasonal_naive(grid.dense(t.sparse(spark, sf)), t.DAY).select(*CELL, "predicted")


@query
def ewma(spark, sf):
    return baselines.ewma(grid.dense(t.sparse(spark, sf))).select(*CELL, "predicted")


@query
def k_sigma_alerts(spark, sf):
    return baselines.k_sigma_alerts(grid.dense(t.sparse(spark, sf)), t.WINDOW).select(*CELL, "alert")


@query
def k_sigma_alerts_240(spark, sf):
    return baselines.k_sigma_alerts(grid.dense(t.sparse(spark, sf)), 240).select(*CELL, "alert")


def _alert_rate(spark, sf, fleet=None):
    seen = t.sparse(spark, sf)
    alerts = baselines.k_sigma_alerts(seen, t.WINDOW)
    step = grid.step_seconds(seen).scalar()
    return baselines.alert_rate(alerts, step, alerting.grid_cells(seen), fleet)


@query
def alert_rate(spark, sf):
    return _alert_rate(spark, sf)


@query
def alert_projection(spark, sf):
    return _alert_rate(spark, sf, alerting.DEFAULT_FLEET).select("alerts_per_series_per_day", "daily_alerts")


@query
def threshold_cost_report(spark, sf):
    seen = t.sparse(spark, sf)
    step = grid.step_seconds(seen).scalar()
    return alerting.threshold_cost(seen, alerting.grid_cells(seen), step, t.WINDOW)


# --- features -------------------------------------------------------------------------------


def _features(spark, sf, *parts):
    built = features.build(grid.dense(t.sparse(spark, sf)), t.SPEC, parts)
    return built.drop("pos", "value")


@query
def features_lags(spark, sf):
    return _features(spark, sf, "lags")


@query
def features_rolling(spark, sf):
    return _features(spark, sf, "rolling")


@query
def features_rolling_240(spark, sf):
    spec = features.FeatureSpec(day=t.DAY)
    return features.build(grid.dense(t.sparse(spark, sf)), spec, ("rolling",)).drop("pos", "value")


@query
def features_daily(spark, sf):
    return _features(spark, sf, "daily")


@query
def features_calendar(spark, sf):
    times = t.events(spark, sf).select("timestamp").distinct()
    return times.select("timestamp", *features.calendar())


@query
def features_all(spark, sf):
    return _features(spark, sf, "lags", "rolling", "daily", "calendar")


# --- forecaster -----------------------------------------------------------------------------


@query
def change_target(spark, sf):
    return forecast.with_change(grid.dense(t.sparse(spark, sf))).select(*CELL, "anchor", "target")


def _training(spark, sf):
    seen = t.clean_grid(spark, sf)
    train, _ = grid.split(seen, 0.7)
    return train, forecast.training_rows(forecast.with_change(train))


@query
def training_rows(spark, sf):
    return _training(spark, sf)[1].select(*CELL, "anchor", "target")


@query
def train_row_counts(spark, sf):
    return forecast.training_counts(*_training(spark, sf))


@query
def quantile_ladder(spark, sf):
    model = forecasting.fit(t.clean_grid(spark, sf), t.forecast_plan(spark, sf))
    return model.select(*SERIES, "hour", *rungs("quantiles"))


@query
def boosted_forecast(spark, sf):
    """The trees at their default settings."""
    found = forecasting.boosted_predictions(t.clean_grid(spark, sf), t.forecast_plan(spark, sf), t.SPEC, BoostConfig())
    return found.select(*CELL, "value", *rungs("q"))


@query
def boosted_quality(spark, sf):
    """Per metric what must hold of the boosted forecasts: rows, missing ladders, their order, and a loss not above that of the hourly ladder."""
    seen, plan = t.clean_grid(spark, sf), t.forecast_plan(spark, sf)
    found = {
        "boosted": stored(forecasting.boosted_predictions(seen, plan, t.SPEC, BoostConfig())),
        "ladder": forecasting.predictions(seen, plan),
    }
    loss = sum(F.avg(pinball(F.col("value"), F.get("q", F.lit(i)), p)) for i, p in enumerate(LEVELS))
    scores = {name: rows.groupBy("metric").agg(loss.alias(name)) for name, rows in found.items()}
    missing = F.col("q").isNull()
    ordered = F.bool_and(missing | (F.col("q") == F.array_sort("q")))
    checks = found["boosted"].groupBy("metric").agg(
        F.count(F.lit(1)).alias("rows"), F.sum(missing.cast("long")).alias("without_ladder"), ordered.alias("ordered")
    )
    both = checks.join(scores["boosted"], "metric").join(scores["ladder"], "metric")
    return both.select("metric", "rows", "without_ladder", "ordered", (F.col("boosted") <= F.col("ladder")).alias("not_worse"))


@query
def predict_history(spark, sf):
    seen = t.sparse(spark, sf)
    parts = ("lags", "daily")
    picked = [*CELL, "lag_1", "lag_day_1"]
    sliced = features.build(grid.split(seen, 0.7)[1], t.SPEC, parts).select(*picked)
    full = features.build(seen, t.SPEC, parts).where(F.col("pos") >= grid.split_position(seen, 0.7)).select(
        *CELL, F.col("lag_1").alias("lag_1_full"), F.col("lag_day_1").alias("lag_day_1_full")
    )
    return sliced.join(full, CELL)


@query
def monotone_ladder(spark, sf):
    built = features.build(t.sparse(spark, sf), t.SPEC, ("lags",))
    crossed = F.array("lag_1", "lag_4", "value", "lag_16")
    return built.withColumn("q", monotone(crossed)).select(*CELL, *rungs("q", ["q1", "q2", "q3", "q4"]))


# --- evaluation -----------------------------------------------------------------------------


def _predictions(spark, sf):
    return forecasting.predictions(t.clean_grid(spark, sf), t.forecast_plan(spark, sf))


def _pits(spark, sf):
    return evaluate.with_pit(_predictions(spark, sf)).select(*CELL, "clean", "pit")


@query
def pinball_loss(spark, sf):
    naive = baselines.seasonal_naive(t.sparse(spark, sf), t.DAY)
    losses = [
        F.avg(pinball(F.col("value"), F.col("predicted"), p)).alias(f"loss_{round(p * 100)}") for p in (0.1, 0.5, 0.9)
    ]
    return naive.groupBy("metric").agg(*losses)


@query
def coverage(spark, sf):
    rows = baselines.with_rolling(t.sparse(spark, sf), t.WINDOW)
    two = F.col("std") * 2
    inside = covered(F.col("value"), F.col("mean") - two, F.col("mean") + two)
    return rows.groupBy("metric").agg(F.avg(inside).alias("covered"), F.count(inside).alias("usable"))


@query
def pit_values(spark, sf):
    return _pits(spark, sf)


@query
def ks_pooled(spark, sf):
    return evaluate.ks_distance(_pits(spark, sf))


@query
def ks_per_series(spark, sf):
    return evaluate.ks_distance(_pits(spark, sf), SERIES)


@query
def tail_mass(spark, sf):
    return _pits(spark, sf).agg(*evaluate.tail_mass())


@query
def pit_histogram(spark, sf):
    return evaluate.pit_histogram(_pits(spark, sf), 20)


def _scored(spark, sf):
    plan = t.forecast_plan(spark, sf)
    seen = t.clean_grid(spark, sf)
    return forecasting.with_baselines(seen, plan, forecasting.predictions(seen, plan))


@query
def accuracy_by_metric(spark, sf):
    return forecasting.accuracy_by_metric(_scored(spark, sf))


@query
def accuracy_pooled(spark, sf):
    return forecasting.accuracy_pooled(_scored(spark, sf))


@query
def calibration(spark, sf):
    return forecasting.calibration(_predictions(spark, sf))


@query
def separation(spark, sf):
    return forecasting.separation(_predictions(spark, sf))


@query
def honesty(spark, sf):
    return forecasting.honesty(_predictions(spark, sf))


@query
def honesty_histogram(spark, sf):
    return forecasting.honesty_histogram(_predictions(spark, sf))


@query
def run_header(spark, sf):
    seen = t.clean_grid(spark, sf)
    step = grid.step_seconds(seen).scalar()
    return forecasting.run_header(seen, t.forecast_plan(spark, sf), step)


@query
def forecast_report(spark, sf):
    """All forecast reports from one fit and one table of scored cells."""
    seen = t.clean_grid(spark, sf)
    return forecasting.report(seen, t.forecast_plan(spark, sf), grid.step_seconds(seen).scalar())


@query
def target_comparison(spark, sf):
    return forecasting.target_comparison(t.clean_grid(spark, sf), t.forecast_plan(spark, sf), ("latency_p95_ms", "mem_mb"))


# --- service graph --------------------------------------------------------------------------


@query
def edges(spark, sf):
    return graph.edges(t.services(spark, sf))


@query
def dangling_edges(spark, sf):
    buyers = t.events(spark, sf).where((F.col("event_type") == "purchase") & (F.col("value") > 100))
    known = buyers.select(F.concat(F.lit("u"), F.col("user_id")).alias("name")).distinct()
    return graph.dangling(t.user_calls(spark, sf), known)


@query
def callers_of(spark, sf):
    return graph.callers_of(t.user_calls(spark, sf), "u3")


@query
def upstream_hops(spark, sf):
    return graph.upstream_hops(t.user_calls(spark, sf), t.fault_users(spark, sf))


@query
def blast_radius(spark, sf):
    return t.radius(spark, sf)


@query
def edge_drift(spark, sf):
    linked = t.events(spark, sf).select(
        F.concat(F.lit("u"), F.col("user_id")).alias("caller"),
        F.concat(F.lit("k"), F.get_json_object("props", "$.k")).alias("callee"),
        (F.col("timestamp") < F.lit("2024-01-16").cast("timestamp")).alias("early"),
    )
    return graph.drift(linked.where("early"), linked.where("not early"))


# --- incidents ------------------------------------------------------------------------------


@query
def affected_metrics(spark, sf):
    kinds = F.broadcast(effect_table(spark).select("kind", "metric", "at_caller"))
    return t.incidents(spark, sf).select("incident_id", "kind").join(kinds, "kind")


@query
def affected_split(spark, sf):
    flat = writers.flat_incidents(t.incidents(spark, sf))
    return labels.claims(flat).select("incident_id", "service", "metric", "start", "end")


@query
def label_incidents(spark, sf):
    return t.labelled(spark, sf)


@query
def onset_order(spark, sf):
    return incident_plans.onset_order(t.labelled(spark, sf))


@query
def label_consistency(spark, sf):
    """Labels against an incident table that lost, renamed and moved some of the incidents they were made from."""
    place = F.col("ordinal") % 7
    known = t.incidents(spark, sf)
    damaged = known.where(place != 3).withColumns(
        {
            "incident_id": F.concat("incident_id", F.when(place == 5, "x").otherwise("")),
            "root_service": F.when(place == 6, "nowhere").otherwise(F.col("root_service")),
        }
    )
    return incident_plans.label_problems(t.labelled(spark, sf, known), damaged)


@query
def incident_summary(spark, sf):
    return incident_plans.incident_summary(t.incidents(spark, sf))


def _manifest(spark, sf):
    # both are read several times
    seen, known = stored(t.telemetry(spark, sf)), t.incidents(spark, sf)
    step = grid.step_seconds(stored(grid.indexed(grid.cells(seen)))).scalar()
    return incident_plans.run_manifest(t.labelled(spark, sf, known, seen), known, step)


@query
def run_manifest(spark, sf):
    return _manifest(spark, sf)


def _effects(spark, sf, seen):
    return overlay.effects(t.faults(spark, sf), grid.axis_of(seen), t.hops(spark, sf))


@query
def fault_profile(spark, sf):
    seen = t.observed(spark, sf)
    windows = overlay.fault_windows(t.faults(spark, sf), grid.axis_of(seen)).where(F.col("n") > 0)
    rows = windows.join(F.broadcast(effect_table(spark)), "kind").withColumn(
        "i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))
    )
    factor = multiplier(F.col("i").cast("double"), F.col("n"), F.col("magnitude"))
    return rows.select("ordinal", "metric", "i", factor.alias("factor"))


@query
def fault_propagation(spark, sf):
    rows = _effects(spark, sf, t.observed(spark, sf))
    return rows.select("ordinal", "service", "metric", "hops", "from_pos", "length", "peak")


def _overlaid(spark, sf):
    seen = t.sparse(spark, sf)
    return overlay.apply_faults(grid.dense(seen), _effects(spark, sf, seen))


@query
def fault_overlay(spark, sf):
    return _overlaid(spark, sf).select(*CELL, "value")


@query
def fault_overlay_labels(spark, sf):
    return _overlaid(spark, sf).select(*CELL, "is_anomalous", "incident_id")


@query
def incident_records(spark, sf):
    return overlay.incident_records(t.faults(spark, sf), t.observed(spark, sf), t.hops(spark, sf))


@query
def fault_validate(spark, sf):
    off = t.faults(spark, sf).withColumn("magnitude", F.col("magnitude") * 1.5).withColumn(
        "duration_s", F.when(F.dayofmonth("start") > 20, F.lit(0)).otherwise(F.col("duration_s"))
    )
    return overlay.problems(off).select("ordinal", "kind", "problem")


@query
def impact_report(spark, sf):
    middle = F.lit("2024-01-16").cast("timestamp")
    before, after = F.col("timestamp") < middle, F.col("timestamp") >= middle
    return incident_plans.impact(t.telemetry(spark, sf), "s4", t.hops(spark, sf), before, after)
