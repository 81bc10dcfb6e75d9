"""The forecast report: accuracy, calibration, separation, honesty."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, functions as F

from sparkwatch.functions.ladder import LEVELS, pit, rung
from sparkwatch.operators import baselines, boosting, evaluate, features, forecast
from sparkwatch.operators.features import FeatureSpec
from sparkwatch.operators.grid import axis_of, split, split_position
from sparkwatch.schema import CELL, SERIES
from sparkwatch.session import stored

# The two intervals that are reported.
INTERVALS = ((0.05, 0.95), (0.01, 0.99))


@dataclass(frozen=True)
class ForecastPlan:
    """``day`` is the number of steps in a day; ``history`` is what the test features may see."""

    day: int
    fraction: float = 0.7
    halflife: float = 20.0
    levels: Sequence[float] = LEVELS
    history: str = "slice"
    services: Sequence[str] | None = None
    #: False fits levels instead of changes since the last observation.
    residual_target: bool = True
    #: Least clean training rows of a series; 0 lets any series through.
    least_rows: int = forecast.MIN_TRAINING_ROWS
    #: What a series with fewer is: an error ("raise"), or fitted on what it has with a warning ("warn").
    short: str = "raise"


def chosen(rows: DataFrame, plan: ForecastPlan) -> DataFrame:
    """Only the services asked for. Narrow after the split: the time axis is that of the whole table."""
    return rows if plan.services is None else rows.where(F.col("service").isin(*plan.services))


def test_changes(grid: DataFrame, plan: ForecastPlan) -> DataFrame:
    """Anchors of the test rows. With ``history="slice"`` the first test row has no past."""
    if plan.history == "slice":
        return forecast.with_change(chosen(split(grid, plan.fraction)[1], plan), plan.residual_target)
    if plan.history == "full":
        cut = split_position(grid, plan.fraction)
        return forecast.with_change(chosen(grid, plan), plan.residual_target).where(F.col("pos") >= cut)
    raise ValueError("history must be 'slice' or 'full'")


def train_changes(grid: DataFrame, plan: ForecastPlan) -> DataFrame:
    """The clean rows of the training part."""
    return forecast.training_rows(forecast.with_change(chosen(split(grid, plan.fraction)[0], plan), plan.residual_target))


def fit(grid: DataFrame, plan: ForecastPlan) -> DataFrame:
    """Model table of the ladder forecaster. A series with fewer than ``plan.least_rows`` clean rows is what ``plan.short`` says."""
    train = stored(train_changes(grid, plan))
    check_rows(grid, plan, train)
    return forecast.fit_ladder(train, plan.levels)


def check_rows(grid: DataFrame, plan: ForecastPlan, train: DataFrame) -> None:
    if plan.least_rows > 0:
        forecast.require_rows(forecast.training_counts(chosen(grid, plan), train), plan.least_rows, plan.short)


def predictions(grid: DataFrame, plan: ForecastPlan, model: DataFrame | None = None) -> DataFrame:
    """Test cells with the ladder ``q``."""
    model = fit(grid, plan) if model is None else model
    return forecast.predict_ladder(test_changes(grid, plan), model)


def boosted_rows(grid: DataFrame, plan: ForecastPlan, spec: FeatureSpec) -> tuple[DataFrame, DataFrame]:
    """Training and test rows of the tree forecaster: change targets with features.

    Features of the test part see only the test part when ``history="slice"``.
    """
    early, late = split(grid, plan.fraction)

    def ready(part: DataFrame) -> DataFrame:
        return features.build(forecast.with_change(chosen(part, plan), plan.residual_target), spec)

    train = forecast.training_rows(ready(early))
    if plan.history == "slice":
        return train, ready(late)
    return train, ready(grid).where(F.col("pos") >= split_position(grid, plan.fraction))


def boosted_predictions(grid: DataFrame, plan: ForecastPlan, spec: FeatureSpec, config: boosting.BoostConfig) -> DataFrame:
    """Test cells with the ladder ``q`` of boosted trees. A series with too few clean rows is what ``plan.short`` says."""
    train, test = boosted_rows(grid, plan, spec)
    train = stored(train)
    check_rows(grid, plan, train)
    model = boosting.fit(train, spec.names, config)
    return boosting.predict(test, spec.names, model, config)


def with_baselines(grid: DataFrame, plan: ForecastPlan, predicted: DataFrame) -> DataFrame:
    """Predictions next to those of the two baselines, which see all the history."""
    cut = split_position(grid, plan.fraction)
    naive = baselines.seasonal_naive(chosen(grid, plan), plan.day, out="seasonal")
    both = baselines.ewma(naive, plan.halflife, out="ewma").where(F.col("pos") >= cut)
    return predicted.join(both.select(*CELL, "seasonal", "ewma"), CELL)


def _losses(levels: Sequence[float]) -> list[Column]:
    return [
        F.avg(evaluate.pinball(F.col("value"), predicted, 0.5)).alias(name)
        for name, predicted in (
            ("forecaster", rung(F.col("q"), levels, 0.5)),
            ("seasonal", F.col("seasonal")),
            ("ewma", F.col("ewma")),
        )
    ]


def accuracy_by_metric(scored: DataFrame, levels: Sequence[float] = LEVELS) -> DataFrame:
    """Median loss per metric over the metric's own spread (a spread of 0 counts as 1)."""
    rows = scored.groupBy("metric").agg(F.stddev_pop("value").alias("_spread"), *_losses(levels))
    spread = F.when(F.coalesce("_spread", F.lit(0.0)) == 0, F.lit(1.0)).otherwise(F.col("_spread"))
    return rows.select("metric", spread.alias("spread"), *[(F.col(c) / spread).alias(c) for c in ("forecaster", "seasonal", "ewma")])


def accuracy_pooled(scored: DataFrame, levels: Sequence[float] = LEVELS) -> DataFrame:
    return scored.agg(*_losses(levels))


def calibration(predicted: DataFrame, levels: Sequence[float] = LEVELS) -> DataFrame:
    """Coverage on clean cells, a row per interval."""
    clean = predicted.where(F.col("clean"))
    return _per_interval(clean.agg(*_coverages(levels)), ["covered"])


def separation(predicted: DataFrame, levels: Sequence[float] = LEVELS) -> DataFrame:
    """Coverage on clean cells next to coverage on anomalous ones, a row per interval."""
    clean = F.when(F.col("clean"), F.col("value"))
    other = F.when(~F.col("clean"), F.col("value"))
    both = predicted.agg(*_coverages(levels, clean, "clean"), *_coverages(levels, other, "anomalous"))
    return _per_interval(both, ["clean", "anomalous"])


def _coverages(levels: Sequence[float], actual: Column | None = None, name: str = "covered") -> list[Column]:
    return [
        evaluate.interval_coverage(lo, hi, levels, actual).alias(f"{name}_{i}") for i, (lo, hi) in enumerate(INTERVALS)
    ]


def _per_interval(row: DataFrame, names: list[str]) -> DataFrame:
    structs = [
        F.struct(F.lit(round(hi - lo, 9)).alias("nominal"), *[F.col(f"{n}_{i}").alias(n) for n in names])
        for i, (lo, hi) in enumerate(INTERVALS)
    ]
    return row.select(F.inline(F.array(*structs)))


def honesty(predicted: DataFrame, levels: Sequence[float] = LEVELS) -> DataFrame:
    """One row: distance from uniform and mass pinned at either end, on clean cells."""
    # read by the counts, their total and the ends
    pits = stored(evaluate.with_pit(predicted.where(F.col("clean")), levels).select("pit"))
    ends = pits.agg(*evaluate.tail_mass())
    # two one-row results side by side
    return evaluate.ks_distance(pits).withColumn("_one", F.lit(1)).join(ends.withColumn("_one", F.lit(1)), "_one").drop("_one")


def honesty_histogram(predicted: DataFrame, bins: int = 10, levels: Sequence[float] = LEVELS) -> DataFrame:
    return evaluate.pit_histogram(evaluate.with_pit(predicted.where(F.col("clean")), levels).select("pit"), bins)


def report(grid: DataFrame, plan: ForecastPlan, step: Column | float, bins: int = 10) -> DataFrame:
    """All reports above in one long table (``section, item, name, value``), from one fit and one table of scored cells.

    Accuracy, calibration, separation, pinned mass and the PIT histogram are one aggregation over it, per metric and in all; only the distance
    from uniform orders values. Times of the header are seconds since the epoch.
    """
    both = with_baselines(grid, plan, predictions(grid, plan))
    cells = stored(both.select(*CELL, "value", "clean", "q", "seasonal", "ewma", pit(F.col("value"), F.col("q"), plan.levels).alias("pit")))
    names = ("forecaster", "seasonal", "ewma")
    clean = F.coalesce(F.col("clean"), F.lit(False))
    sure = F.when(clean, F.col("pit"))
    counts = [F.sum((evaluate.pit_bin(sure, bins) == b).cast("long")).alias(f"_bin_{b}") for b in range(bins)]
    sums = cells.rollup("metric").agg(
        F.grouping("metric").alias("_all"),
        F.stddev_pop("value").alias("spread"),
        *_losses(plan.levels),
        *_coverages(plan.levels, F.when(clean, F.col("value")), "clean"),
        *_coverages(plan.levels, F.when(~clean, F.col("value")), "anomalous"),
        F.avg((sure <= 0).cast("double")).alias("below"),
        F.avg((sure >= 1).cast("double")).alias("above"),
        F.count(sure).alias("_n"),
        *counts,
    )
    sums = stored(sums)
    spread = F.when(F.coalesce("spread", F.lit(0.0)) == 0, F.lit(1.0)).otherwise(F.col("spread"))
    by_metric, overall = F.col("_all") == 0, F.col("_all") == 1
    nominal = [str(round(hi - lo, 9)) for lo, hi in INTERVALS]
    entries: list[tuple[Column, str, Column, str, Column]] = [(by_metric, "accuracy", F.col("metric"), "spread", spread)]
    entries += [(by_metric, "accuracy", F.col("metric"), n, F.col(n) / spread) for n in names]
    entries += [(overall, "pooled", F.lit(""), n, F.col(n)) for n in names]
    for i, share in enumerate(nominal):
        entries.append((overall, "calibration", F.lit(share), "covered", F.col(f"clean_{i}")))
        entries += [(overall, "separation", F.lit(share), side, F.col(f"{side}_{i}")) for side in ("clean", "anomalous")]
    entries += [(overall, "honesty", F.lit(""), n, F.col(n)) for n in ("below", "above")]
    for b in range(bins):
        entries.append((overall, "histogram", F.lit(str(b)), "observed", F.coalesce(F.col(f"_bin_{b}"), F.lit(0))))
        entries.append((overall, "histogram", F.lit(str(b)), "ratio", F.try_divide(F.col(f"_bin_{b}"), F.col("_n") / F.lit(float(bins)))))
    parts = [_long(sums, entries)]
    distance = evaluate.ks_distance(cells.where(clean & F.col("pit").isNotNull()).select("pit"))
    parts.append(_long(distance, [(F.lit(True), "honesty", F.lit(""), n, F.col(n)) for n in ("ks", "n")]))
    head = run_header(grid, plan, step)
    number = lambda f: F.unix_micros(f.name) / F.lit(1e6) if f.dataType.simpleString() == "timestamp" else F.col(f.name)
    parts.append(_long(head, [(F.lit(True), "header", F.lit(""), f.name, number(f)) for f in head.schema.fields]))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def _long(rows: DataFrame, entries: Sequence[tuple[Column, str, Column, str, Column]]) -> DataFrame:
    """Entries (when, section, item, name, value) of each row as rows of their own."""
    made = [
        F.when(when, F.struct(F.lit(section).alias("section"), item.cast("string").alias("item"), F.lit(name).alias("name"), value.cast("double").alias("value")))
        for when, section, item, name, value in entries
    ]
    return rows.select(F.inline(F.filter(F.array(*made), lambda e: e.isNotNull())))


def target_comparison(grid: DataFrame, plan: ForecastPlan, metrics: Sequence[str]) -> DataFrame:
    """Levels against changes as targets: a row per target with the median's loss, coverage of both intervals, distance from uniform and
    pinned mass over the chosen metrics' cells."""
    parts = []
    for target, changes in (("change", True), ("level", False)):
        found = predictions(grid, replace(plan, residual_target=changes)).where(F.col("metric").isin(*metrics))
        cells = stored(found.select("value", "q", pit(F.col("value"), F.col("q"), plan.levels).alias("pit")))
        loss = F.avg(evaluate.pinball(F.col("value"), rung(F.col("q"), plan.levels, 0.5), 0.5)).alias("pinball")
        pinned = [F.avg((F.col("pit") <= 0).cast("double")).alias("below"), F.avg((F.col("pit") >= 1).cast("double")).alias("above")]
        scores = cells.agg(loss, *_coverages(plan.levels), *pinned).withColumn("target", F.lit(target))
        distance = evaluate.ks_distance(cells.where("pit IS NOT NULL").select("pit")).withColumn("target", F.lit(target))
        parts.append(scores.join(distance, "target"))
    return parts[0].unionByName(parts[1]).select("target", "pinball", F.col("covered_0").alias("covered_90"), F.col("covered_1").alias("covered_98"), "ks", "n", "below", "above")


def run_header(grid: DataFrame, plan: ForecastPlan, step: Column | float) -> DataFrame:
    """One row: series, step, bounds and length of both periods, anomalous share of the test cells.

    A grid cell without a row counts as anomalous, so the share is taken over series x test times.
    """
    axis = axis_of(grid)
    cut = split_position(grid, plan.fraction)
    rows = chosen(grid, plan)
    step = step if isinstance(step, Column) else F.lit(float(step))
    n_series = rows.select(*SERIES).distinct().agg(F.count(F.lit(1)).alias("n")).scalar()
    clean = rows.where((F.col("pos") >= cut) & F.col("clean")).agg(F.count(F.lit(1)).alias("n")).scalar()
    early = F.col("pos") < cut
    bounds = axis.agg(
        F.min(F.when(early, F.col("timestamp"))).alias("train_start"),
        F.max(F.when(early, F.col("timestamp"))).alias("train_end"),
        F.count(F.when(early, 1)).alias("train_steps"),
        F.min(F.when(~early, F.col("timestamp"))).alias("test_start"),
        F.max(F.when(~early, F.col("timestamp"))).alias("test_end"),
        F.count(F.when(~early, 1)).alias("test_steps"),
    )
    share = F.lit(1.0) - F.try_divide(clean.cast("double"), n_series * F.col("test_steps"))
    return bounds.select(
        n_series.alias("series"), step.alias("step_seconds"), *bounds.columns, share.alias("anomalous_share")
    )
