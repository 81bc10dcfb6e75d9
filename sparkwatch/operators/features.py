"""Leak-free features: everything but the calendar comes from strictly earlier positions."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F, types as T

from sparkwatch.operators.baselines import rolling
from sparkwatch.operators.grid import DAY_SECONDS, at_lag, chunk_window, chunked, own_rows

# The short lags and rolling windows, in steps, the daily look-backs and the calendar periods.
SHORT_LAGS = (1, 2, 4, 8, 16)
ROLL_WINDOWS = (60, 240)
DAYS_BACK = (1, 2)
WEEK_SECONDS = 604_800


@dataclass(frozen=True)
class FeatureSpec:
    """What to build; ``day`` is the number of steps in a day."""

    day: int
    lags: tuple[int, ...] = field(default=SHORT_LAGS)
    windows: tuple[int, ...] = field(default=ROLL_WINDOWS)
    days_back: tuple[int, ...] = field(default=DAYS_BACK)

    @property
    def back(self) -> int:
        """How far back any feature reaches."""
        return max([5, *self.lags, *self.windows, *(self.day * d for d in self.days_back)])

    @property
    def names(self) -> list[str]:
        rolls = [f"{stat}_{w}" for w in self.windows for stat in ("mean", "std")]
        return (
            [f"lag_{n}" for n in self.lags]
            + ["delta_1", "delta_4"]
            + rolls
            + [f"lag_day_{d}" for d in self.days_back]
            + ["day_sin", "day_cos", "week_sin", "week_cos"]
        )


def steps_per_day(step: float) -> int:
    """Python rounds halves to even, and so does this."""
    return int(round(DAY_SECONDS / step))


def spec_for_step(step: float) -> FeatureSpec:
    return FeatureSpec(day=steps_per_day(step))


def calendar(timestamp: str = "timestamp") -> list[Column]:
    """The clock as two points on circles: one turn per day and one per (epoch-anchored) week."""
    seconds = F.unix_micros(F.col(timestamp)) / F.lit(1e6)

    def turn(period: int) -> Column:
        return F.lit(2.0) * F.pi() * F.pmod(seconds, F.lit(float(period))) / F.lit(float(period))

    day, week = turn(DAY_SECONDS), turn(WEEK_SECONDS)
    return [
        F.sin(day).alias("day_sin"),
        F.cos(day).alias("day_cos"),
        F.sin(week).alias("week_sin"),
        F.cos(week).alias("week_cos"),
    ]


def lag_columns(spec: FeatureSpec) -> list[Column]:
    """Lags and the two recent slopes; for chunked rows."""
    w = chunk_window()
    recent = at_lag(w, 1)
    return [at_lag(w, n).alias(f"lag_{n}") for n in spec.lags] + [
        (recent - at_lag(w, 2)).alias("delta_1"),
        (recent - at_lag(w, 5)).alias("delta_4"),
    ]


def daily_columns(spec: FeatureSpec) -> list[Column]:
    w = chunk_window()
    return [at_lag(w, spec.day * d).alias(f"lag_day_{d}") for d in spec.days_back]


def build(
    grid: DataFrame,
    spec: FeatureSpec,
    parts: tuple[str, ...] = ("lags", "rolling", "daily", "calendar"),
    chunk_rows: int | None = None,
) -> DataFrame:
    """The grid with the chosen feature groups, or all of them, in their fixed order.

    All groups share one layout of the rows, so the rows are shuffled once.
    """
    if not isinstance(grid.schema["timestamp"].dataType, T.TimestampType):
        raise TypeError("the grid must be indexed by a timestamp column")
    laid = chunked(grid, spec.back, chunk_rows)
    added: list[Column] = []
    if "lags" in parts:
        added += lag_columns(spec)
    if "daily" in parts:
        added += daily_columns(spec)
    rows = laid.select(*laid.columns, *added)
    if "rolling" in parts:
        for width in spec.windows:
            rows = rolling(rows, width)
            enough = F.col(f"n_{width}") >= width // 4
            for name in (f"mean_{width}", f"std_{width}"):
                rows = rows.withColumn(name, F.when(enough, F.col(name)))
    rows = own_rows(rows)
    if "calendar" in parts:
        rows = rows.select(*rows.columns, *calendar())
    return rows.select(*grid.columns, *[n for n in spec.names if n in rows.columns])
