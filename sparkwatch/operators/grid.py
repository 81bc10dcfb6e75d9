"""The time grid every detector works on.

Offsets ("four steps back", "the last 240 rows") count positions on the axis of *all* distinct timestamps
of the table, and a series without a sample at a timestamp still takes up that position.
Cells are therefore numbered once, by ``pos``, and windows use range frames over ``pos``: a
sparse table of observed cells then gives the same answers as the filled grid, and nothing has to be
filled in unless rows for missing cells are wanted in the output.

A series may be arbitrarily long, so windows never partition by series alone. ``chunked``
cuts each series into stretches of positions and copies in front of each the rows its look-back
needs; the window partition is (series, stretch), whose size is bounded by the parameters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from sparkwatch.functions.percentiles import exact_median
from sparkwatch.schema import CELL, SERIES

DAY_SECONDS = 86_400
_HOUR_SECONDS = 3600
_FILL_BLOCK = 1024
_FILL_SALTS = 32
_MIN_CHUNK = 4096


def cells(long: DataFrame) -> DataFrame:
    """One averaged row per observed (timestamp, service, metric); missing samples dropped."""
    return long.where(F.col("value").isNotNull()).groupBy(*CELL).agg(F.avg("value").alias("value"))


def time_axis(observed: DataFrame) -> DataFrame:
    """Distinct timestamps numbered from 0.

    Numbered inside each second (at most a million microseconds), then shifted by the sizes of the seconds before in the hour and of the
    hours before; only the table of hours (one row each) is ordered in one place, so times may be as dense as they can be.
    """
    times = observed.select("timestamp").distinct().withColumn("_second", _second("timestamp"))
    inside = Window.partitionBy("_second").orderBy("timestamp")
    numbered = times.withColumn("_nth", F.row_number().over(inside) - 1)
    sizes = times.groupBy("_second").agg(F.count(F.lit(1)).alias("_size"))
    return numbered.join(_offsets(sizes), "_second").select(
        "timestamp", (F.col("_nth") + F.col("_offset")).cast("long").alias("pos")
    )


def _second(column: str) -> Column:
    return F.unix_seconds(F.col(column))


def _offsets(sizes: DataFrame) -> DataFrame:
    """Running ``_size`` of all seconds before each second."""
    sizes = sizes.withColumn("_hour", F.expr(f"floor(_second / {_HOUR_SECONDS})"))
    earlier = Window.partitionBy("_hour").orderBy("_second").rowsBetween(Window.unboundedPreceding, -1)
    running = Window.orderBy("_hour").rowsBetween(Window.unboundedPreceding, -1)
    hours = sizes.groupBy("_hour").agg(F.sum("_size").alias("_size"))
    hours = hours.select("_hour", F.coalesce(F.sum("_size").over(running), F.lit(0)).alias("_before"))
    inside = sizes.withColumn("_inside", F.coalesce(F.sum("_size").over(earlier), F.lit(0)))
    return inside.join(hours, "_hour").select("_second", (F.col("_before") + F.col("_inside")).alias("_offset"))


def positions_of(axis: DataFrame, points: DataFrame, out: str = "before") -> DataFrame:
    """Per distinct ``timestamp`` of ``points``: how many axis timestamps lie strictly before it.

    Points and axis are ranked together, second by second, so that no pair of them is ever joined.
    """
    asked = points.select("timestamp").distinct()
    mixed = (
        axis.select("timestamp", F.lit(1).alias("_axis"))
        .unionByName(asked.select("timestamp", F.lit(0).alias("_axis")))
        .withColumn("_second", _second("timestamp"))
    )
    offsets = _offsets(mixed.groupBy("_second").agg(F.sum("_axis").alias("_size")))
    inside = Window.partitionBy("_second").orderBy("timestamp", "_axis").rowsBetween(Window.unboundedPreceding, -1)
    return (
        mixed.withColumn("_seen", F.coalesce(F.sum("_axis").over(inside), F.lit(0)))
        .where(F.col("_axis") == 0)
        .join(offsets, "_second")
        .select("timestamp", (F.col("_seen") + F.col("_offset")).cast("long").alias(out))
    )


def indexed(observed: DataFrame) -> DataFrame:
    """Observed cells with their axis position: the sparse grid.

    Most reports read the grid more than once; ``session.stored`` keeps that from rebuilding it.
    """
    return observed.join(time_axis(observed), "timestamp")


def axis_of(grid: DataFrame) -> DataFrame:
    """The axis of a grid that has not been narrowed to some series."""
    return grid.select("timestamp", "pos").distinct()


def axis_length(grid: DataFrame) -> Column:
    """Number of axis positions, as a scalar subquery."""
    return grid.agg((F.coalesce(F.max("pos"), F.lit(-1)) + 1).alias("n")).scalar()


def dense(grid: DataFrame) -> DataFrame:
    """Every series at every axis position, missing samples as NULL.

    This is the size of the answer (series x times). Use the sparse grid when rows for missing cells are not
    part of what is asked. Series meet the times block by block, and salted, so that the rows of a block
    come from many tasks however many series there are.
    """
    blocks = F.sequence(F.lit(0).cast("long"), F.floor((axis_length(grid) - 1) / _FILL_BLOCK))
    salts = F.explode(F.sequence(F.lit(0), F.lit(_FILL_SALTS - 1))).alias("_salt")
    times = axis_of(grid).select("timestamp", "pos", F.expr(f"pos div {_FILL_BLOCK}").alias("_block"), salts)
    slots = (
        grid.select(*SERIES)
        .distinct()
        .select(*SERIES, F.pmod(F.hash(*SERIES), F.lit(_FILL_SALTS)).alias("_salt"), F.explode(blocks).alias("_block"))
        .join(times, ["_block", "_salt"])
        .select("timestamp", "pos", *SERIES, F.lit(None).cast("double").alias("value"))
    )
    known = grid.select("timestamp", "pos", *SERIES, "value")
    return slots.unionByName(known).groupBy("timestamp", "pos", *SERIES).agg(F.max("value").alias("value"))


def chunked(
    grid: DataFrame, back: int, rows: int | None = None, by: list[str] | None = None, pos: str = "pos"
) -> DataFrame:
    """Cut each series into stretches, each led by copies of the ``back`` positions before it.

    ``own`` marks the rows that belong to the stretch. The copies cost at most a quarter more rows,
    since a stretch is four look-backs long unless ``rows`` says otherwise. Rows are placed by (series, stretch) here, once
    for all windows that follow, also those over parts of a stretch.
    """
    size = max(int(rows or max(_MIN_CHUNK, 4 * back)), 1)
    first = F.expr(f"{pos} div {size}")
    last = F.expr(f"({pos} + {int(back)}) div {size}")
    return (
        grid.withColumn("_first", first)
        .withColumn("chunk", F.explode(F.sequence(F.col("_first"), last)))
        .withColumn("own", F.col("chunk") == F.col("_first"))
        .drop("_first")
        .repartition(*(SERIES if by is None else by), "chunk")
    )


def own_rows(df: DataFrame) -> DataFrame:
    """Drop the look-back copies again."""
    return df.where(F.col("own")).drop("own", "chunk")


def chunk_window(by: list[str] | None = None, pos: str = "pos") -> WindowSpec:
    return Window.partitionBy(*(SERIES if by is None else by), "chunk").orderBy(pos)


def at_lag(window: WindowSpec, steps: int, value: str | Column = "value") -> Column:
    """The value ``steps`` positions back, NULL if that cell is missing."""
    return F.max(value).over(window.rangeBetween(-steps, -steps))


def step_seconds(grid: DataFrame) -> DataFrame:
    """One row, ``step_seconds``: the median gap between successive timestamps."""
    axis = chunked(axis_of(grid), 1, by=[])
    micros = F.unix_micros("timestamp")
    gaps = own_rows(
        axis.withColumn("_gap", (micros - at_lag(chunk_window([]), 1, micros)) / F.lit(1e6))
    ).where(F.col("_gap").isNotNull())
    return exact_median(gaps, [], "_gap", "step_seconds")


def require_step(grid: DataFrame) -> float:
    """The step as a number; an axis of fewer than two timestamps has none."""
    row = step_seconds(grid).first()
    if row is None or row["step_seconds"] is None:
        raise ValueError("need at least two timestamps to tell the step")
    return float(row["step_seconds"])


def wide(long: DataFrame, series: list[str], separator: str = "/") -> DataFrame:
    """Export view: one row per timestamp, one column for each of the named series (service, separator, metric).

    The series are asked for by name: a table may have far more of them than a row can have columns.
    """
    named = cells(long).withColumn("series", F.concat_ws(separator, *SERIES))
    return named.groupBy("timestamp").pivot("series", list(series)).agg(F.first("value"))


def unpivot(table: DataFrame, separator: str = "/") -> DataFrame:
    """A wide table back to long rows, missing cells kept as NULL."""
    columns = [c for c in table.columns if c != "timestamp"]
    series = table.unpivot("timestamp", [F.col(f"`{c}`") for c in columns], "series", "value")
    parts = F.split("series", separator, 2)
    return series.select("timestamp", parts[0].alias("service"), parts[1].alias("metric"), "value")


def clean_cells(labelled: DataFrame, order: list[str]) -> DataFrame:
    """Cells with ``clean``: the first label by ``order`` that is there says healthy; a cell without label is not clean."""
    # min_by leaves out rows whose order is NULL
    first = F.min_by("is_anomalous", F.when(F.col("is_anomalous").isNotNull(), F.struct(*order)))
    return labelled.groupBy(*CELL).agg(
        F.avg("value").alias("value"), (~F.coalesce(first, F.lit(True))).alias("clean")
    )


def split(grid: DataFrame, fraction: float = 0.7) -> tuple[DataFrame, DataFrame]:
    """Train and test rows: in time order at a share of the distinct timestamps, never at random."""
    cut = split_position(grid, fraction)
    return grid.where(F.col("pos") < cut), grid.where(F.col("pos") >= cut)


def split_position(grid: DataFrame, fraction: float) -> Column:
    """First test position, as a scalar subquery over a grid not narrowed to some series."""
    size = F.coalesce(F.max("pos"), F.lit(-1)) + 1
    return grid.agg(F.floor(size * F.lit(float(fraction))).alias("cut")).scalar()


def residuals(joined: DataFrame, actual: str = "value", predicted: str = "predicted") -> DataFrame:
    return joined.withColumn("residual", F.col(actual) - F.col(predicted))
