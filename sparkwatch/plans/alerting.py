"""What threshold alerting costs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from sparkwatch.operators.baselines import beyond, rate_per_series_day, with_rolling
from sparkwatch.operators.grid import DAY_SECONDS, axis_length
from sparkwatch.schema import SERIES

# How often a normal variable lies beyond k deviations, either side.
GAUSSIAN_TWO_SIDED = {2.0: 0.0455, 2.5: 0.0124, 3.0: 0.0027, 3.5: 0.000465}
DEFAULT_KS = (2.0, 2.5, 3.0, 3.5)
DEFAULT_FLEET = 5000


def grid_cells(grid: DataFrame) -> Column:
    """Series x times of the table, as a scalar subquery; nothing is filled in to count it."""
    series = grid.select(*SERIES).distinct().agg(F.count(F.lit(1)).alias("n")).scalar()
    return series * axis_length(grid)


def threshold_cost(
    grid: DataFrame,
    cells: Column,
    step: Column | float,
    window: int,
    ks: Sequence[float] = DEFAULT_KS,
    fleet: int = DEFAULT_FLEET,
) -> DataFrame:
    """One row per k: observed and Gaussian alert rate, their ratio, alerts per day of a fleet.

    Means and deviations are computed once; each k is one more sum over the same rows. A k outside the
    Gaussian table has no expected rate.
    """
    step = step if isinstance(step, Column) else F.lit(float(step))
    scored = with_rolling(grid, window)
    sums = [F.coalesce(F.sum(beyond(k).cast("long")), F.lit(0)).alias(f"_k{i}") for i, k in enumerate(ks)]
    counted = scored.agg(*sums).withColumn("_cells", cells)
    per_k = F.array(
        *[
            F.struct(
                F.lit(float(k)).alias("k"),
                F.col(f"_k{i}").alias("alerts"),
                F.lit(GAUSSIAN_TWO_SIDED.get(float(k))).cast("double").alias("gaussian_rate"),
            )
            for i, k in enumerate(ks)
        ]
    )
    rows = counted.select("_cells", F.inline(per_k))
    rate = rate_per_series_day(F.col("alerts"), F.col("_cells"), step)
    observed = F.col("alerts_per_series_per_day") / (F.lit(float(DAY_SECONDS)) / step)
    return (
        rows.withColumn("alerts_per_series_per_day", rate)
        .withColumn("observed_rate", observed)
        .withColumn("inflation", F.col("observed_rate") / F.col("gaussian_rate"))
        .withColumn("fleet_daily_alerts", F.col("alerts_per_series_per_day") * fleet)
        .drop("_cells")
    )
