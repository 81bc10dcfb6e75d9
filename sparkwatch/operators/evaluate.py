"""Scores for forecasts: loss, coverage, and how uniform the residual is.

Every score of an empty input is NULL.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from sparkwatch.functions.ladder import LEVELS, covered, pinball, pit, rung

_KS_CELLS = 65_536


def pinball_loss(level: float, actual: str = "value", predicted: str = "predicted") -> Column:
    """Aggregate: mean quantile loss."""
    return F.avg(pinball(F.col(actual), F.col(predicted), level))


def coverage(actual: Column, lower: Column, upper: Column) -> Column:
    """Aggregate: share of rows inside their interval."""
    return F.avg(covered(actual, lower, upper))


def interval_coverage(lo: float, hi: float, levels: Sequence[float] = LEVELS, actual: Column | None = None) -> Column:
    """Aggregate: coverage of the interval between two rungs of column ``q``."""
    actual = F.col("value") if actual is None else actual
    return coverage(actual, rung(F.col("q"), levels, lo), rung(F.col("q"), levels, hi))


def with_pit(predicted: DataFrame, levels: Sequence[float] = LEVELS) -> DataFrame:
    """Rows with a usable ``pit``; the others are dropped."""
    return predicted.withColumn("pit", pit(F.col("value"), F.col("q"), levels)).where(F.col("pit").isNotNull())


def ks_distance(pits: DataFrame, by: Sequence[str] = (), cells: int = _KS_CELLS) -> DataFrame:
    """Kolmogorov-Smirnov distance of ``pit`` from uniform, overall or per group.

    Equal values are counted together first. The unit interval is then cut into cells; counts run
    inside a cell and the cell totals run across cells, so no task orders all values.
    """
    keys = list(by)
    counts = pits.groupBy(*keys, "pit").agg(F.count(F.lit(1)).alias("_c"))
    counts = counts.withColumn("_cell", F.least(F.floor(F.col("pit") * cells), F.lit(cells - 1)))
    across = Window.partitionBy(*keys).orderBy("_cell") if keys else Window.orderBy("_cell")
    everything = across.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    totals = counts.groupBy(*keys, "_cell").agg(F.sum("_c").alias("_m")).select(
        *keys,
        "_cell",
        F.coalesce(F.sum("_m").over(across.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"),
        F.sum("_m").over(everything).alias("_n"),
    )
    inside = Window.partitionBy(*keys, "_cell").orderBy("pit")
    upto = counts.withColumn("_upto", F.sum("_c").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    placed = upto.join(totals, keys + ["_cell"])
    reached = F.col("_base") + F.col("_upto")
    gap = F.greatest(reached / F.col("_n") - F.col("pit"), F.col("pit") - (reached - F.col("_c")) / F.col("_n"))
    result = placed.groupBy(*keys).agg(F.max(gap).alias("ks"), F.sum("_c").alias("n"))
    return result.withColumn("n", F.coalesce("n", F.lit(0)))


def tail_mass(below: str = "below", above: str = "above") -> list[Column]:
    """Aggregates: shares of ``pit`` pinned to either end."""
    return [
        F.avg((F.col("pit") <= 0).cast("double")).alias(below),
        F.avg((F.col("pit") >= 1).cast("double")).alias(above),
    ]


def pit_bin(value: Column, bins: int) -> Column:
    """The equal bin of [0, 1] that a value is in.

    A value is first put in the bin its product with ``bins`` suggests and then moved by one if the
    bin's edge, as a double, says otherwise.
    """
    width = 1.0 / bins
    guess = F.least(F.floor(value * bins), F.lit(bins - 1))
    moved = (
        F.when(value < guess * F.lit(width), guess - 1)
        .when((value >= (guess + 1) * F.lit(width)) & (guess < bins - 1), guess + 1)
        .otherwise(guess)
    )
    return F.when(value.isNotNull(), moved.cast("long"))


def pit_histogram(pits: DataFrame, bins: int = 20) -> DataFrame:
    """Counts per equal bin of [0, 1] against the expected count; empty bins included."""
    width = 1.0 / bins
    counts = pits.groupBy(pit_bin(F.col("pit"), bins).alias("bin")).agg(F.count(F.lit(1)).alias("observed"))
    frame = pits.sparkSession.range(bins).withColumnRenamed("id", "bin")
    filled = frame.join(counts, "bin", "left").withColumn("observed", F.coalesce("observed", F.lit(0)))
    all_bins = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    expected = F.nullif(F.sum("observed").over(all_bins), F.lit(0)) / F.lit(float(bins))
    return filled.select(
        "bin",
        (F.col("bin") * F.lit(width)).alias("from"),
        F.when(F.col("bin") == bins - 1, F.lit(1.0)).otherwise((F.col("bin") + 1) * F.lit(width)).alias("to"),
        "observed",
        (F.col("observed") / expected).alias("ratio"),
    )
