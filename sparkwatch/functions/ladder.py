"""Expressions on a ladder of predicted quantiles, held as one array per row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from sparkwatch.schema import finite

# The default quantile levels.
LEVELS = (0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99)


def monotone(ladder: Column) -> Column:
    """Repair crossed quantiles by sorting; missing rungs go last."""
    return F.array_sort(ladder)


def rung(ladder: Column, levels: Sequence[float], level: float) -> Column:
    return F.get(ladder, F.lit(list(levels).index(level)))


def usable(actual: Column, ladder: Column) -> Column:
    """An actual and a complete ladder, all ordinary numbers."""
    return finite(actual) & ladder.isNotNull() & F.forall(ladder, finite)


def pit(actual: Column, ladder: Column, levels: Sequence[float] = LEVELS) -> Column:
    """Where the actual falls in its own forecast: interpolated level, 0 below and 1 above the ladder.

    On tied rungs the highest of the tied levels counts. NULL where actual or ladder is unusable.
    """
    ordered = F.array_sort(ladder)
    rungs = len(levels)
    names = F.array(*[F.lit(float(p)) for p in levels])
    reached = F.size(F.filter(ordered, lambda q: q <= actual))
    low, high = F.get(ordered, reached - 1), F.get(ordered, reached)
    at, above = F.get(names, reached - 1), F.get(names, reached)
    inside = at + (actual - low) / F.nullif(high - low, F.lit(0.0)) * (above - at)
    top = F.when(actual == F.get(ordered, F.lit(rungs - 1)), F.lit(float(levels[-1]))).otherwise(F.lit(1.0))
    value = F.when(reached == 0, F.lit(0.0)).when(reached == rungs, top).otherwise(inside)
    return F.when(usable(actual, ladder), value)


def pinball(actual: Column, predicted: Column, level: float) -> Column:
    """Quantile loss of one row; NULL where the error is not finite."""
    error = actual - predicted
    loss = F.when(error >= 0, F.lit(level) * error).otherwise(F.lit(level - 1.0) * error)
    return F.when(finite(error), loss)


def covered(actual: Column, lower: Column, upper: Column) -> Column:
    """1 or 0, ends included; NULL unless all three are finite."""
    inside = (actual >= lower) & (actual <= upper)
    return F.when(finite(actual) & finite(lower) & finite(upper), inside.cast("double"))
