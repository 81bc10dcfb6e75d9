"""Overlapping intervals settled into disjoint ones, without comparing intervals with each other.

The ends of a group's intervals cut its line into pieces. An interval of many pieces is spelled out as a few nodes of the 16-way tree over the
piece numbers (at most thirty per level), values that meet on a node are combined there, and a piece combines the nodes above it, one
per level. Work is in proportion to the number of intervals times the logarithm of it, however they overlap and however long they are.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Bits of a piece number that a level of the tree takes away.
_BITS = 4


def settle(
    intervals: DataFrame,
    by: Sequence[str],
    start: str,
    stop: str,
    combine: Mapping[str, Callable[[str], Column]],
) -> DataFrame:
    """Disjoint half-open pieces ``start`` to ``stop`` per ``by`` with the columns of ``combine``, put together over all intervals that
    cover the piece. Ends are whole numbers; intervals that end before they start, or at their start, are not there.

    ``combine`` names columns and the aggregates that put them together; an aggregate must not mind order or grouping. Every interval counts
    once in a piece.
    """
    by = list(by)
    there = intervals.where(F.col(start) < F.col(stop))
    group = Window.partitionBy(*by)
    points = there.select(*by, F.explode(F.array(start, stop)).alias("_at")).distinct()
    places = points.select(
        *by,
        "_at",
        (F.row_number().over(group.orderBy("_at")) - 1).cast("long").alias("_rank"),
        F.lead("_at").over(group.orderBy("_at")).alias("_next"),
        F.count(F.lit(1)).over(group).alias("_points"),
    )
    first = places.select(*by, F.col("_at").alias(start), F.col("_rank").alias("_a"))
    last = places.select(*by, F.col("_at").alias(stop), F.col("_rank").alias("_b"))
    spans = there.join(first, [*by, start]).join(last, [*by, stop])
    nodes = spans.select(*by, *combine, F.inline(_cover("_a", "_b")))
    nodes = nodes.groupBy(*by, "_level", "_node").agg(*[f(name).alias(name) for name, f in combine.items()])

    height = F.ceil(F.log2(F.col("_points").cast("double")) / _BITS).cast("int")
    above = F.transform(
        F.sequence(F.lit(0), height), lambda level: F.struct(level.alias("_level"), F.call_function("shiftright", F.col("_rank"), level * _BITS).alias("_node"))
    )
    pieces = places.where(F.col("_next").isNotNull()).select(*by, F.col("_at").alias(start), F.col("_next").alias(stop), F.inline(above))
    found = pieces.join(nodes, [*by, "_level", "_node"])
    return found.groupBy(*by, start, stop).agg(*[f(name).alias(name) for name, f in combine.items()])


def _cover(a: str, b: str) -> Column:
    """The tree nodes that make up the pieces a to b - 1: on each level those whose parent is not in the range as a whole."""

    def between(low: Column, high: Column) -> Column:
        return F.when(low < high, F.sequence(low, high - 1)).otherwise(F.array().cast("array<bigint>"))

    def on_level(level: Column) -> Column:
        bits = level * _BITS
        unit = F.call_function("shiftleft", F.lit(1).cast("long"), bits)
        low = F.call_function("shiftright", F.col(a) + unit - 1, bits)
        high = F.call_function("shiftright", F.col(b), bits)
        # the whole parents reach from here to there
        first = F.call_function("shiftleft", F.call_function("shiftright", low + ((1 << _BITS) - 1), F.lit(_BITS)), F.lit(_BITS))
        last = F.call_function("shiftleft", F.call_function("shiftright", high, F.lit(_BITS)), F.lit(_BITS))
        nodes = F.when(first < last, F.concat(between(low, first), between(last, high))).otherwise(between(low, high))
        return F.transform(nodes, lambda node: F.struct(level.alias("_level"), node.alias("_node")))

    # no node above the length of the span
    top = F.floor(F.log2((F.col(b) - F.col(a)).cast("double")) / _BITS).cast("int")
    return F.flatten(F.transform(F.sequence(F.lit(0), top), on_level))
