"""Exact percentiles per group that do not gather a group in one task.

Spark's own ``percentile`` keeps every distinct value of a group in one aggregation buffer, and a group may hold a third of a huge
table. Order statistics are found by radix selection instead. The source is read once: its values are counted (combined before the
shuffle, spread by group and value) and written. A group with at most 2^20 different values is put in order as it is. A larger one is cut
into cells by sign and 4,096th of an octave, which keeps the order; counts are summed per cell, and only the values of cells that hold a
wanted rank are ordered, after these were cut into even slices as often as it takes for 2^20 different values.

Several groupings of the same rows share the counts. Infinities have cells of their own, and NaN is greater than any number, as in
Spark's ordering.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, Window, functions as F

from sparkwatch.session import discard, stored

_PER_OCTAVE = 4096
_OCTAVES = 1100
_SLICES = 4096
#: Most different values that are put in order in one task.
_ORDERED = 1 << 20


def exact_percentiles(
    df: DataFrame, keys: Sequence[str], value: str, levels: Sequence[float], out: str = "levels", ordered: int = _ORDERED
) -> DataFrame:
    """One row per group: ``keys`` and ``out``, an array with one value per level, linear between the nearest ranks.

    NULL values do not count; a group without others has no row. Rows without a key are a group like others. Between infinities of different
    sign, and next to NaN, there is only NaN.
    """
    (found,) = grouped_percentiles(df, [list(keys)], value, levels, out, ordered)
    return found


def grouped_percentiles(
    df: DataFrame, groupings: Sequence[Sequence[str]], value: str, levels: Sequence[float], out: str = "levels", ordered: int = _ORDERED
) -> list[DataFrame]:
    """The same for several groupings, from one pass over ``df``: a frame for each, with a further column ``rows``."""
    keys = list(dict.fromkeys(k for grouping in groupings for k in grouping))
    marked = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    seen = Observation()
    counts = stored(marked.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_n")).observe(seen, F.count(F.lit(1)).alias("n")))
    # equal structs are equal also where fields are null
    names = [F.struct(F.lit(i).alias("_grouping"), *[F.col(k) if k in g else F.lit(None).cast(df.schema[k].dataType).alias(k) for k in keys]) for i, g in enumerate(groupings)]
    name = F.explode(F.array(*names)) if len(names) > 1 else names[0]
    values = counts.select(name.alias("_key"), "_v", "_n")
    wanted = F.array_distinct(F.array(*[edge for p in levels for edge in _rank_edges(p)]))
    written = [counts]
    group = Window.partitionBy("_key")
    most = seen.get["n"] if seen.get["n"] <= ordered else values.groupBy("_key").count().agg(F.max("count")).first()[0]
    if most <= ordered:
        # the whole group is one cell
        near = values.select("*", _before(group.orderBy("_v"), "_n").alias("_start"), F.sum("_n").over(group).alias("_total")).withColumn("_ranks", wanted)
    else:
        near = _narrowed(values, wanted, ordered, written)
    picked = (
        _holding(near, "_n")
        .select("_key", "_v", "_total", F.explode("_ranks").alias("_rank"))
        .groupBy("_key")
        # at most two ranks per level, whatever the size of the group
        .agg(F.map_from_entries(F.collect_list(F.struct("_rank", "_v"))).alias("_at"), F.first("_total").alias("_total"))
    )
    answers = []
    for p in levels:
        low, high = _rank_edges(p)
        weight = (F.col("_total") - 1) * F.lit(float(p)) - low
        below, above = F.element_at("_at", low), F.element_at("_at", high)
        answers.append(F.when((weight == 0) | (below == above), below).otherwise(below + (above - below) * weight))
    done = stored(picked.select("_key", F.array(*answers).alias("_answers"), "_total"))
    for table in written:
        discard(table)
    return [
        done.where(F.col("_key._grouping") == i).select(*[F.col("_key")[k].alias(k) for k in g], F.col("_answers").alias(out), *([F.col("_total").alias("rows")] if len(groupings) > 1 else []))
        for i, g in enumerate(groupings)
    ]


def _narrowed(values: DataFrame, wanted: Column, ordered: int, written: list[DataFrame]) -> DataFrame:
    """The values of the cells that hold a wanted rank, with ``_start``, ``_total`` and ``_ranks``; tables it writes are added to ``written``."""
    total = Window.partitionBy("_key")
    values = values.select("*", F.lit(0).cast("long").alias("_part"), _cell(F.col("_v")).alias("_cell"))
    cells = _summed(values)
    cells = cells.select("*", _before(total.orderBy("_cell"), "_m").alias("_start"), F.sum("_m").over(total).alias("_total"))
    held = stored(_holding(cells.withColumn("_ranks", wanted), "_m"))
    written.append(held)
    while (held.agg(F.max(F.when(F.col("_lo") < F.col("_hi"), F.col("_d")))).first()[0] or 0) > ordered:
        # dense numbers of the cells of a group: at most two per level
        place = F.row_number().over(total.orderBy("_cell")).cast("long").alias("_place")
        inside = values.drop("_part").join(held.select("_key", "_cell", "_lo", "_hi", place), ["_key", "_cell"])
        values = stored(inside.select("_key", "_v", "_n", F.col("_place").alias("_part"), (F.col("_place") * _SLICES + _slice()).alias("_cell")))
        held = held.select("_key", place, "_start", "_total", "_ranks")
        cells = _summed(values).join(held.withColumnsRenamed({"_place": "_part", "_start": "_from"}), ["_key", "_part"])
        cells = cells.withColumn("_start", F.col("_from") + _before(Window.partitionBy("_key", "_part").orderBy("_cell"), "_m")).drop("_from")
        held = stored(_holding(cells, "_m"))
        written += [values, held]
    near = values.join(held.select("_key", "_cell", "_start", "_total", "_ranks"), ["_key", "_cell"])
    return near.withColumn("_start", F.col("_start") + _before(Window.partitionBy("_key", "_cell").orderBy("_v"), "_n"))


def exact_median(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    found = exact_percentiles(df, keys, value, [0.5], "_at")
    return found.select(*keys, F.col("_at")[0].alias(out))


def _summed(values: DataFrame) -> DataFrame:
    """Rows, different values and bounds per cell."""
    sums = [F.sum("_n").alias("_m"), F.count(F.lit(1)).alias("_d"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")]
    return values.groupBy("_key", "_part", "_cell").agg(*sums)


def _cell(v: Column) -> Column:
    """A coarse, order-preserving cell of a double: sign, then a slice of its octave."""
    size = F.floor((F.log2(F.abs(v)) + F.lit(float(_OCTAVES))) * F.lit(_PER_OCTAVE)).cast("long") + 1
    last = 4 * _OCTAVES * _PER_OCTAVE
    finite = F.when(v > 0, size).when(v < 0, -size).otherwise(F.lit(0).cast("long"))
    return (
        F.when(F.isnan(v), F.lit(last + 1).cast("long"))
        .when(v == float("inf"), F.lit(last).cast("long"))
        .when(v == float("-inf"), F.lit(-last).cast("long"))
        .otherwise(finite)
    )


def _slice() -> Column:
    """A linear slice of a cell; one of equal values (among them infinities and NaN) has a single one."""
    # halves, so that the distance of two large numbers stays finite
    share = (F.col("_v") / 2 - F.col("_lo") / 2) / (F.col("_hi") / 2 - F.col("_lo") / 2)
    return F.when(F.col("_lo") < F.col("_hi"), F.least(F.floor(share * _SLICES), F.lit(_SLICES - 1))).otherwise(0).cast("long")


def _rank_edges(level: float) -> tuple[Column, Column]:
    at = (F.col("_total") - 1) * F.lit(float(level))
    return F.floor(at).cast("long"), F.ceil(at).cast("long")


def _before(window, amount: str) -> Column:
    running = F.sum(amount).over(window.rowsBetween(Window.unboundedPreceding, -1))
    return F.coalesce(running, F.lit(0)).cast("long")


def _holding(df: DataFrame, width: str) -> DataFrame:
    """Keep the rows whose stretch of ranks, ``_start`` to ``_start + width``, holds a wanted one."""
    start, end = F.col("_start"), F.col("_start") + F.col(width)
    kept = F.filter("_ranks", lambda r: (r >= start) & (r < end))
    return df.withColumn("_ranks", kept).where(F.size("_ranks") > 0)
