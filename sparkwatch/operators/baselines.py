"""Baseline forecasters and the k-sigma alert rule, over a sparse or dense grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from sparkwatch.operators.grid import DAY_SECONDS, at_lag, chunk_window, chunked, own_rows
from sparkwatch.schema import SERIES

# Frames up to this many rows are recomputed per row; longer ones are put together from halves.
_SHORT_FRAME = 32


def seasonal_naive(grid: DataFrame, period: int, lookback: int = 3, out: str = "predicted", chunk_rows: int | None = None) -> DataFrame:
    """Median of the values one, two, ... periods back; those that are missing are skipped."""
    w = chunk_window()
    seen = F.array_compact(F.array(*[at_lag(w, period * k) for k in range(1, lookback + 1)]))
    laid = chunked(grid, period * lookback, chunk_rows).withColumn("_seen", seen)
    return own_rows(laid.withColumn(out, median_of(F.col("_seen")))).drop("_seen")


def median_of(values: Column) -> Column:
    """Median of a small array without NULLs; NULL when empty."""
    ranked = F.array_sort(values)
    n = F.size(values)
    low = F.get(ranked, F.floor((n - 1) / 2).cast("int"))
    high = F.get(ranked, F.floor(n / 2).cast("int"))
    return (low + high) / 2


def ewma(grid: DataFrame, halflife: float = 20.0, min_points: int = 5, out: str = "predicted") -> DataFrame:
    """Exponentially weighted mean of everything before the row, NULL until enough points.

    Weights double every ``halflife`` positions, so a plain running sum overflows. Each series is cut into
    blocks of 500 half-lives with sums on the block's own scale, and a block starts
    from a carried (sum, weight) pair. The carry needs only the last two non-empty blocks: anything
    older weighs less than 2^-495 of them, far below double precision.
    """
    size = max(int(500 * halflife), 1)
    place = F.col("pos") - F.col("_block") * size
    weight = F.when(F.col("value").isNotNull(), F.pow(F.lit(2.0), place / F.lit(float(halflife))))
    rows = grid.withColumn("_block", F.expr(f"pos div {size}")).withColumn("_w", weight)

    shrink = F.lit(2.0 ** (-size / halflife))
    totals = rows.groupBy(*SERIES, "_block").agg(
        (F.sum(F.col("value") * F.col("_w")) * shrink).alias("_num"),
        (F.sum("_w") * shrink).alias("_den"),
        F.count("value").alias("_cnt"),
    )
    past = Window.partitionBy(*SERIES).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)

    def faded(blocks: Column) -> Column:
        return F.pow(F.lit(2.0), -blocks * F.lit(size / float(halflife)))

    filled = F.when(F.col("_cnt") > 0, F.struct("_block", "_num", "_den"))
    totals = totals.withColumn("_prev", F.last(filled, ignorenulls=True).over(past))
    fade = faded(F.col("_block") - F.col("_prev._block"))
    both = F.struct(
        F.col("_block").alias("at"),
        (F.col("_num") + F.coalesce(F.col("_prev._num") * fade, F.lit(0.0))).alias("num"),
        (F.col("_den") + F.coalesce(F.col("_prev._den") * fade, F.lit(0.0))).alias("den"),
    )
    carries = totals.withColumn("_both", F.when(F.col("_cnt") > 0, both)).select(
        *SERIES,
        "_block",
        F.last("_both", ignorenulls=True).over(past).alias("_carry"),
        F.coalesce(F.sum("_cnt").over(past), F.lit(0)).alias("_older"),
    )

    inside = Window.partitionBy(*SERIES, "_block").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    local = rows.select(
        *grid.columns,
        "_block",
        F.sum(F.col("value") * F.col("_w")).over(inside).alias("_lnum"),
        F.sum("_w").over(inside).alias("_lden"),
        F.count("value").over(inside).alias("_lcnt"),
    ).join(carries, SERIES + ["_block"])

    fade = faded(F.col("_block") - 1 - F.col("_carry.at"))
    carried = F.col("_carry.num") / F.col("_carry.den")
    merged = (F.col("_lnum") + F.coalesce(F.col("_carry.num") * fade, F.lit(0.0))) / (
        F.col("_lden") + F.coalesce(F.col("_carry.den") * fade, F.lit(0.0))
    )
    mean = F.when(F.col("_lden").isNull(), carried).otherwise(merged)
    return local.select(*grid.columns, F.when(F.col("_older") + F.col("_lcnt") >= min_points, mean).alias(out))


def rolling(laid: DataFrame, window: int, prefix: str = "") -> DataFrame:
    """Add count, mean and sample deviation of the ``window`` positions before each row.

    ``laid`` must be chunked with a look-back of at least ``window``. The columns are ``{prefix}n_{window}``,
    ``{prefix}mean_{window}`` and ``{prefix}std_{window}``; the mean needs one point and the deviation two.

    Spark recomputes a sliding frame for every row. For long frames the axis is cut every ``window`` positions, so
    that a frame is the tail of one segment and the head of the next; both come from running
    aggregates, and their moments are merged. A flat window gives exactly 0.
    """
    n, mean, std = (f"{prefix}{name}_{window}" for name in ("n", "mean", "std"))
    if window <= _SHORT_FRAME:
        frame = chunk_window().rangeBetween(-window, -1)
        return laid.select(
            *laid.columns,
            F.count("value").over(frame).alias(n),
            F.avg("value").over(frame).alias(mean),
            F.stddev_samp("value").over(frame).alias(std),
        )

    segment = F.expr(f"pos div {window}")
    cut = laid.withColumn("_seg", segment)
    in_segment = Window.partitionBy(*SERIES, "chunk", "_seg")
    tail = in_segment.orderBy(F.col("pos").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    head = in_segment.orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    reach = (
        Window.partitionBy(*SERIES, "chunk").orderBy(F.col("pos").desc()).rangeBetween(Window.unboundedPreceding, window)
    )
    cut = cut.withColumn("_tail", F.struct("_seg", *_moments(tail)))
    cut = cut.withColumn("_tail", F.last("_tail").over(reach))
    cut = cut.withColumn("_head", F.struct(*_moments(head)))

    def part(side: str, name: str) -> Column:
        found = F.col(f"{side}.{name}")
        return F.when(F.col("_tail._seg") == F.col("_seg") - 1, found) if side == "_tail" else found

    count = F.coalesce(part("_tail", "n"), F.lit(0)) + F.coalesce(part("_head", "n"), F.lit(0))
    total = F.coalesce(part("_tail", "s"), F.lit(0.0)) + F.coalesce(part("_head", "s"), F.lit(0.0))
    gap = F.try_divide(part("_tail", "s"), part("_tail", "n")) - F.try_divide(part("_head", "s"), part("_head", "n"))
    between = gap * gap * F.try_divide(part("_tail", "n") * part("_head", "n"), count)
    spread = F.coalesce(part("_tail", "m"), F.lit(0.0)) + F.coalesce(part("_head", "m"), F.lit(0.0))
    spread = spread + F.coalesce(between, F.lit(0.0))
    flat = F.least(part("_tail", "lo"), part("_head", "lo")) == F.greatest(part("_tail", "hi"), part("_head", "hi"))
    return cut.select(
        *laid.columns,
        count.alias(n),
        F.when(count >= 1, total / count).alias(mean),
        F.when((count >= 2) & flat, F.lit(0.0)).when(count >= 2, F.sqrt(spread / (count - 1))).alias(std),
    )


def _moments(over) -> list[Column]:
    v = F.col("value")
    n = F.count(v).over(over)
    return [
        n.alias("n"),
        F.sum(v).over(over).alias("s"),
        (F.var_pop(v).over(over) * n).alias("m"),
        F.min(v).over(over).alias("lo"),
        F.max(v).over(over).alias("hi"),
    ]


def with_rolling(grid: DataFrame, window: int, chunk_rows: int | None = None) -> DataFrame:
    """``mean`` and ``std`` of the past window, NULL until a quarter of it is filled."""
    laid = rolling(chunked(grid, window, chunk_rows), window)
    enough = F.col(f"n_{window}") >= window // 4
    return own_rows(laid).select(
        *grid.columns,
        F.when(enough, F.col(f"mean_{window}")).alias("mean"),
        F.when(enough, F.col(f"std_{window}")).alias("std"),
    )


def beyond(k: Column | float) -> Column:
    """The k-sigma rule on ``value``, ``mean`` and ``std``; undecidable cells stay quiet."""
    k = k if isinstance(k, Column) else F.lit(float(k))
    fired = (F.abs(F.col("value") - F.col("mean")) > k * F.col("std")) & (F.col("std") > 0)
    return F.coalesce(fired, F.lit(False))


def k_sigma_alerts(
    grid: DataFrame, window: int = 240, k: float = 3.0, chunk_rows: int | None = None, evaluated_only: bool = False
) -> DataFrame:
    """The grid with ``alert``: more than ``k`` past deviations away from the past mean.

    Cells that cannot be judged (missing, or too little past) are quiet, and count as cells in an alert rate. With
    ``evaluated_only`` their alert is NULL, and they do not count.
    """
    scored = with_rolling(grid, window, chunk_rows)
    alert = beyond(k)
    if evaluated_only:
        alert = F.when(F.col("value").isNotNull() & F.col("std").isNotNull(), alert)
    return scored.withColumn("alert", alert).drop("mean", "std")


def rate_per_series_day(fired: Column, usable: Column, step: Column | float) -> Column:
    """Alerts per series per day; 0 without a usable cell."""
    step = step if isinstance(step, Column) else F.lit(float(step))
    return F.when(usable == 0, F.lit(0.0)).otherwise(fired / (usable * step / F.lit(float(DAY_SECONDS))))


def alert_rate(
    alerts: DataFrame,
    step: Column | float,
    grid_cells: Column | None = None,
    fleet: int | None = None,
) -> DataFrame:
    """One row: cells, alerts, alerts per series per day and, for a ``fleet``, the projection to it.

    Rows with NULL ``alert`` do not count as cells. For a sparse frame pass the number of grid
    cells, which includes those without a sample.
    """
    counted = alerts.agg(F.coalesce(F.sum(F.col("alert").cast("long")), F.lit(0)).alias("alerts"), F.count("alert").alias("cells"))
    if grid_cells is not None:
        counted = counted.withColumn("cells", F.coalesce(grid_cells, F.lit(0)).cast("long"))
    rate = rate_per_series_day(F.col("alerts"), F.col("cells"), step)
    counted = counted.withColumn("alerts_per_series_per_day", rate)
    if fleet is None:
        return counted
    return counted.withColumn("daily_alerts", F.col("alerts_per_series_per_day") * F.lit(fleet))
