"""Raw scraped samples to telemetry: rates, ratios, histogram percentiles, gauges.

Samples are rows (timestamp, label columns..., value). A rate counts the increases whose later sample falls in the
window and is not stretched to the window's edges.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from sparkwatch.functions.percentiles import exact_percentiles
from sparkwatch.operators.grid import chunk_window, chunked, own_rows

MICROS = 1_000_000
# Finite bucket bounds of the request duration histogram, in seconds, and the least denominator of a ratio.
LATENCY_BOUNDS = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0)
LEAST_RATE = 1e-9
#: Windows of so few steps are summed step by step.
_SHORT_WINDOW = 8


def increases(samples: DataFrame, labels: Sequence[str], window_seconds: int) -> DataFrame:
    """Growth of each counter since its previous sample within the window; a drop is a reset to 0.

    Samples without a number (NULL or NaN) are not there: the next one grows from the one before them.
    """
    span = window_seconds * MICROS
    there = samples.where(F.col("value").isNotNull() & ~F.isnan("value"))
    laid = chunked(there.withColumn("_at", F.unix_micros("timestamp")), span, 8 * span, list(labels), "_at")
    before = F.last("value").over(chunk_window(list(labels), "_at").rangeBetween(-span + 1, -1))
    rows = own_rows(laid.withColumn("_before", before)).where(F.col("_before").isNotNull())
    grown = F.when(F.col("value") < F.col("_before"), F.col("value")).otherwise(F.col("value") - F.col("_before"))
    return rows.select("timestamp", *labels, grown.alias("increase"))


def _steps(at_micros: Column, step: int, reach: int) -> Column:
    """The step times (in steps since the epoch) at which a sample is still within reach."""
    first = F.ceil(at_micros / F.lit(step * MICROS))
    last = F.ceil((at_micros + F.lit(reach * MICROS)) / F.lit(step * MICROS)) - 1
    return F.filter(F.sequence(first, F.greatest(first, last)), lambda s: s <= last)


def rate(samples: DataFrame, labels: Sequence[str], by: Sequence[str], window_seconds: int = 60, step_seconds: int = 15) -> DataFrame:
    """Per step and ``by``: growth per second over the trailing window, summed over the other labels.

    Increases are summed per step first. A window of many steps is then the tail of one stretch of steps and the head of the next, both
    running sums, so that no increase is copied to the steps that see it; steps whose window is empty have no row.
    """
    at, step = F.unix_micros("timestamp"), step_seconds * MICROS
    first = F.ceil(at / F.lit(step))
    seen_by = F.ceil((at + F.lit(window_seconds * MICROS)) / F.lit(step)) - first
    slots = increases(samples, labels, window_seconds).groupBy(*by, first.alias("_step"), seen_by.alias("_seen"))
    slots = slots.agg(F.sum("increase").alias("_v"))
    # a sample is in the window of so many steps, or one more where steps do not divide the window
    widths = sorted({window_seconds // step_seconds, -(-window_seconds // step_seconds)} - {0})
    parts = [_windowed(slots.where(F.col("_seen") == k).drop("_seen"), list(by), k) for k in widths]
    if len(parts) > 1:
        both = parts[0].unionByName(parts[1])
        parts = [both.groupBy(*by, "_step").agg(F.sum("_v").alias("_v"))]
    value = F.col("_v") / F.lit(float(window_seconds))
    return parts[0].select(F.timestamp_seconds(F.col("_step") * step_seconds).alias("timestamp"), *by, value.alias("value"))


def _windowed(slots: DataFrame, by: list[str], k: int) -> DataFrame:
    """Sums over the last ``k`` steps, for every step with a slot among them."""
    if k <= _SHORT_WINDOW:
        copies = slots.withColumn("_step", F.explode(F.sequence(F.col("_step"), F.col("_step") + k - 1)))
        return copies.groupBy(*by, "_step").agg(F.sum("_v").alias("_v"))
    size = max(4096, 4 * k)
    laid = chunked(slots, k, size, by, "_step").drop("own")
    place = chunk_window(by, "_step")
    # up to the step before the next slot, the last one that sees this slot, or the end of the chunk
    until = F.least(F.lead("_step").over(place) - 1, F.col("_step") + k - 1, (F.col("chunk") + 1) * size - 1)
    laid = laid.withColumn("_until", F.greatest(until, F.col("_step")))
    steps = laid.withColumn("_at", F.explode(F.sequence("_step", "_until")))
    steps = steps.select(*by, "chunk", F.col("_at").alias("_step"), F.when(F.col("_at") == F.col("_step"), F.col("_v")).alias("_v"))
    steps = steps.withColumn("_stretch", F.expr(f"_step div {k}"))
    stretch = Window.partitionBy(*by, "chunk", "_stretch")
    upto = Window.unboundedPreceding, Window.currentRow
    reach = Window.partitionBy(*by, "chunk").orderBy(F.col("_step").desc()).rangeBetween(Window.unboundedPreceding, k - 1)
    steps = steps.withColumn("_tail", F.struct("_stretch", F.sum("_v").over(stretch.orderBy(F.col("_step").desc()).rowsBetween(*upto)).alias("v")))
    steps = steps.withColumn("_head", F.sum("_v").over(stretch.orderBy("_step").rowsBetween(*upto)))
    # the tail at the first step that is still in the window
    steps = steps.withColumn("_tail", F.last("_tail").over(reach))
    earlier = F.when(F.col("_tail._stretch") == F.col("_stretch") - 1, F.col("_tail.v"))
    total = F.coalesce("_head", F.lit(0.0)) + F.coalesce(earlier, F.lit(0.0))
    return steps.where(F.expr(f"_step div {size}") == F.col("chunk")).select(*by, "_step", total.alias("_v"))


def event_rate(events: DataFrame, by: Sequence[str], width_seconds: int = 60) -> DataFrame:
    """The same for a table of single events: events per second in each window."""
    slot = F.floor(F.unix_seconds("timestamp") / width_seconds) * width_seconds
    return (
        events.groupBy(slot.alias("_slot"), *by)
        .agg((F.count(F.lit(1)) / F.lit(float(width_seconds))).alias("value"))
        .select(F.timestamp_seconds("_slot").alias("timestamp"), *by, "value")
    )


def error_ratio(rates: DataFrame) -> DataFrame:
    """Share of 5xx in the rate per (timestamp, service); services without any 5xx series have no row."""
    failing = F.col("status").rlike("^5..$")
    return (
        rates.groupBy("timestamp", "service")
        .agg(F.sum(F.when(failing, F.col("value"))).alias("_bad"), F.sum("value").alias("_all"))
        .where(F.col("_bad").isNotNull())
        .select("timestamp", "service", (F.col("_bad") / F.greatest("_all", F.lit(LEAST_RATE))).alias("value"))
    )


def histogram_percentile(buckets: DataFrame, level: float, by: Sequence[str] = ("timestamp", "service")) -> DataFrame:
    """Percentile from cumulative buckets (``le``, ``value``), interpolated inside the bucket.

    Above the last finite bound that bound is the answer; without any observation there is none.
    """
    # one entry per bucket bound
    held = F.array_sort(F.collect_list(F.struct(F.col("le"), F.col("value").alias("cum"))))
    rows = buckets.groupBy(*by, "le").agg(F.sum("value").alias("value")).groupBy(*by).agg(held.alias("_b"))
    total = F.element_at("_b", -1)["cum"]
    rows = rows.withColumn("_rank", F.lit(level) * total).where(F.element_at("_b", -1)["le"] == float("inf"))
    at = F.size(F.filter("_b", lambda b: b["cum"] < F.col("_rank")))
    rows = rows.withColumn("_at", at).withColumn("_total", total)
    this, last = F.get("_b", F.col("_at")), F.get("_b", F.col("_at") - 1)
    low, under = F.coalesce(last["le"], F.lit(0.0)), F.coalesce(last["cum"], F.lit(0.0))
    inside = low + (this["le"] - low) * F.try_divide(F.col("_rank") - under, this["cum"] - under)
    found = F.when(F.col("_at") >= F.size("_b") - 1, F.get("_b", F.size("_b") - 2)["le"]).otherwise(inside)
    return rows.select(*by, F.when(F.col("_total") > 0, found).alias("value"))


def latency_p95_ms(rates: DataFrame) -> DataFrame:
    """Latency in milliseconds from bucket rates in seconds."""
    return histogram_percentile(rates, 0.95).withColumn("value", F.col("value") * 1000)


def raw_percentile(events: DataFrame, by: Sequence[str], value: str = "value", level: float = 0.95) -> DataFrame:
    """The exact percentile, where single observations are at hand."""
    found = exact_percentiles(events, by, value, [level], "_at")
    return found.select(*by, F.col("_at")[0].alias("value"))


def last_per_step(samples: DataFrame, by: Sequence[str], step_seconds: int = 15, lookback_seconds: int = 300) -> DataFrame:
    """Per step the latest sample at or before it, not older than the look-back.

    Samples are first reduced to the latest before each step, and only that one is carried on.
    """
    at = F.unix_micros("timestamp")
    latest = F.max(F.struct(F.col("_at"), F.col("value"))).alias("_last")
    reduced = (
        samples.where(F.col("value").isNotNull())
        .select(*by, at.alias("_at"), "value")
        .groupBy(*by, F.ceil(F.col("_at") / F.lit(step_seconds * MICROS)).alias("_first"))
        .agg(latest)
    )
    carried = reduced.select(
        *by, "_last", F.explode(_steps(F.col("_last._at"), step_seconds, lookback_seconds)).alias("_step")
    )
    return (
        carried.groupBy("_step", *by)
        .agg(F.max("_last").alias("_last"))
        .select(
            F.timestamp_seconds(F.col("_step") * step_seconds).alias("timestamp"), *by, F.col("_last.value").alias("value")
        )
    )


def resample(
    samples: DataFrame, by: Sequence[str], start: str, end: str, step_seconds: int = 15, lookback_seconds: int = 300
) -> DataFrame:
    """``last_per_step`` at start, start + step, ... up to and including end."""
    origin, stop = F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")
    # steps are counted from ``start``, so times are shifted to make it a multiple of the step
    shift = F.pmod(F.unix_micros(origin), F.lit(step_seconds * MICROS))
    reach = F.timestamp_micros(F.unix_micros(origin) - F.lit(lookback_seconds * MICROS))
    near = samples.where((F.col("timestamp") > reach) & (F.col("timestamp") <= stop))
    moved = near.withColumn("timestamp", F.timestamp_micros(F.unix_micros("timestamp") - shift))
    found = last_per_step(moved, by, step_seconds, lookback_seconds)
    back = found.withColumn("timestamp", F.timestamp_micros(F.unix_micros("timestamp") + shift))
    return back.where((F.col("timestamp") >= origin) & (F.col("timestamp") <= stop))
