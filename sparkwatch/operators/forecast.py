"""Quantile forecasts of the next value, predicted as a change from the last one.

``fit_ladder`` / ``predict_ladder`` estimate the quantiles of the change from the past changes of the same
series at the same hour of day. See ``boosting`` for the tree-based forecaster with the same output.
"""

from __future__ import annotations

import warnings
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from sparkwatch.functions.ladder import LEVELS, monotone
from sparkwatch.functions.percentiles import grouped_percentiles
from sparkwatch.operators.grid import at_lag, chunk_window, chunked, own_rows
from sparkwatch.schema import SERIES

# The least rows to fit a series on, and the least rows of an hour to stand on its own.
MIN_TRAINING_ROWS = 100
MIN_BUCKET_ROWS = 40


def with_change(grid: DataFrame, residual_target: bool = True, chunk_rows: int | None = None) -> DataFrame:
    """Add ``anchor`` (the value one position back, or 0 for level targets) and ``target``.

    When the grid has ``clean``, the previous cell's flag is added as ``clean_before``; missing means not clean.
    """
    w = chunk_window()
    laid = chunked(grid, 1, chunk_rows)
    if "clean" in grid.columns:
        before = F.coalesce(at_lag(w, 1, F.col("clean").cast("int")) == 1, F.lit(False))
        laid = laid.withColumn("clean_before", before)
    anchor = at_lag(w, 1) if residual_target else F.lit(0.0)
    laid = laid.withColumn("anchor", anchor)
    return own_rows(laid.withColumn("target", F.col("value") - F.col("anchor")))


def training_rows(changes: DataFrame) -> DataFrame:
    """Rows to fit on: value and anchor present and, if flags exist, both cells clean."""
    usable = changes.where(F.col("target").isNotNull())
    if "clean" in changes.columns:
        usable = usable.where(F.coalesce(F.col("clean"), F.lit(False)) & F.col("clean_before"))
    return usable


def training_counts(grid: DataFrame, train: DataFrame) -> DataFrame:
    """Usable rows per series of the grid, 0 included."""
    found = train.groupBy(*SERIES).agg(F.count(F.lit(1)).alias("_n"))
    every = grid.select(*SERIES).distinct()
    return every.join(found, SERIES, "left").select(*SERIES, F.coalesce("_n", F.lit(0)).alias("rows"))


def require_rows(counts: DataFrame, least: int = MIN_TRAINING_ROWS, short: str = "raise") -> None:
    """Fail when a series has too few usable rows, and name the worst one.

    With ``short="warn"`` that is a warning, and the series is fitted on the rows it has.
    """
    if short not in ("raise", "warn"):
        raise ValueError("short must be 'raise' or 'warn'")
    worst = counts.where(F.col("rows") < least).orderBy("rows", *SERIES).first()
    if worst is None:
        return
    text = f"{worst['service']}/{worst['metric']}: only {worst['rows']} clean rows to fit on"
    if short == "raise":
        raise ValueError(text)
    warnings.warn(text, stacklevel=2)


def fit_ladder(
    train: DataFrame,
    levels: Sequence[float] = LEVELS,
    min_bucket: int = MIN_BUCKET_ROWS,
) -> DataFrame:
    """Model table: per series and hour of day the quantiles of the change, and per series (hour NULL)."""
    hourly = train.withColumn("hour", F.hour("timestamp"))
    keys = SERIES + ["hour"]
    by_hour, overall = grouped_percentiles(hourly, [keys, SERIES], "target", levels, "quantiles")
    by_hour = by_hour.where(F.col("rows") >= min_bucket).select(*keys, "quantiles")
    return by_hour.unionByName(overall.select(*SERIES, F.lit(None).cast("int").alias("hour"), "quantiles"))


def predict_ladder(changes: DataFrame, model: DataFrame | None) -> DataFrame:
    """Add ``q``, the ladder of predicted values; NULL where there is no anchor."""
    if model is None:
        raise RuntimeError("fit before predict")
    by_hour = model.where(F.col("hour").isNotNull()).withColumnRenamed("quantiles", "_hourly")
    overall = model.where(F.col("hour").isNull()).select(*SERIES, F.col("quantiles").alias("_overall"))
    rows = (
        changes.withColumn("hour", F.hour("timestamp"))
        .join(by_hour, SERIES + ["hour"], "left")
        .join(overall, SERIES, "left")
    )
    return rows.withColumn("q", anchored(F.coalesce("_hourly", "_overall"))).drop("hour", "_hourly", "_overall")


def anchored(changes: Column) -> Column:
    """Predicted changes to predicted values, in order of level."""
    moved = F.transform(changes, lambda change: change + F.col("anchor"))
    return F.when(F.col("anchor").isNotNull(), monotone(moved))
