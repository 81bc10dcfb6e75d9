"""Lay faults over healthy telemetry: what a detector would have seen had something broken."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from sparkwatch.functions.profiles import (
    PERMANENT_KIND,
    effect_table,
    inherited,
    known_kind,
    moving_rows,
    multiplier,
    ramp_steps,
)
from sparkwatch.operators.grid import axis_length, axis_of, positions_of
from sparkwatch.operators.intervals import settle
from sparkwatch.schema import SERIES, within_bounds

_BLOCK = 256


@dataclass(frozen=True)
class OverlayConfig:
    """Effect kept per hop, rows of delay per hop, deviation that counts as anomalous."""

    attenuation: float = 0.55
    hop_lag_steps: int = 4
    effect_threshold: float = 0.05


def problems(faults: DataFrame) -> DataFrame:
    """Faults that break a rule, with the rule."""
    magnitude, duration = F.col("magnitude"), F.col("duration_s")
    off_range = magnitude.isNull() | F.isnan(magnitude) | (magnitude <= 0) | (magnitude > 1)
    found = F.filter(
        F.array(
            F.when(off_range, F.lit("magnitude must be above 0 and at most 1")),
            F.when(duration.isNull() | (duration <= 0), F.lit("duration must be positive")),
        ),
        lambda p: p.isNotNull(),
    )
    return faults.withColumn("problem", F.explode(found))


def checked(faults: DataFrame) -> DataFrame:
    """The faults unchanged; the job fails on an invalid one."""
    bad = F.isnan("magnitude") | (F.col("magnitude") <= 0) | (F.col("magnitude") > 1) | F.col("magnitude").isNull()
    late = F.col("duration_s").isNull() | (F.col("duration_s") <= 0)
    verdict = (
        F.when(bad, F.raise_error(F.lit("magnitude must be above 0 and at most 1")).cast("double"))
        .when(late, F.raise_error(F.lit("duration must be positive")).cast("double"))
        .otherwise(F.col("magnitude"))
    )
    return faults.withColumn("magnitude", verdict)


def fault_windows(faults: DataFrame, axis: DataFrame) -> DataFrame:
    """Faults with ``end``, ``permanent`` and their rows on the axis: ``first_pos`` and ``n``.

    A window is half-open; a permanent fault runs to the end of the axis.
    """
    ends = F.timestamp_micros(F.unix_micros("start") + F.col("duration_s") * 1_000_000)
    rows = checked(faults).withColumn("kind", known_kind(F.col("kind"))).withColumn("end", ends)
    edges = rows.select(F.explode(F.array("start", "end")).alias("timestamp"))
    placed = positions_of(axis, edges)
    for edge, name in (("start", "first_pos"), ("end", "_end_pos")):
        rows = rows.join(placed.select(F.col("timestamp").alias(edge), F.col("before").alias(name)), edge)
    rows = rows.withColumn("_length", axis_length(axis))
    rows = rows.withColumn("permanent", F.col("kind") == PERMANENT_KIND)
    stop = F.when(F.col("permanent"), F.col("_length")).otherwise(F.col("_end_pos"))
    return rows.withColumn("n", stop - F.col("first_pos"))


def effects(
    faults: DataFrame, axis: DataFrame, hops: DataFrame, config: OverlayConfig = OverlayConfig()
) -> DataFrame:
    """One row per fault and series it touches: where it starts (``from_pos``), for how many rows
    (``length``), the effect's parameters and ``peak``, its largest deviation.

    Every profile peaks on the last row of its ramp, or on its last row if it is cut short, so the
    largest deviation is known without spelling the profile out. Callers whose peak stays
    within the threshold are left out.
    """
    windows = fault_windows(faults, axis).where(F.col("n") > 0)
    at_origin = windows.withColumn("hops", F.lit(0))
    upstream = hops.select(F.col("origin").alias("_origin"), F.col("service").alias("_caller"), "hops")
    at_callers = windows.join(upstream, F.col("service") == F.col("_origin")).withColumn("service", F.col("_caller"))
    touched = at_origin.unionByName(at_callers.drop("_origin", "_caller"))

    # fifteen fixed rows
    table = F.broadcast(effect_table(faults.sparkSession))
    rows = touched.join(table, "kind").where((F.col("hops") == 0) | F.col("at_caller"))
    rows = rows.withColumn("from_pos", F.col("first_pos") + F.col("hops") * config.hop_lag_steps)
    rows = rows.withColumn("length", F.least("n", F.col("_length") - F.col("from_pos"))).where(F.col("length") > 0)
    at_peak = F.least(ramp_steps(F.col("n")), (F.col("length") - 1).cast("double"))
    rows = rows.withColumn("peak", F.abs(felt(at_peak, config) - 1))
    return rows.where((F.col("hops") == 0) | (F.col("peak") > config.effect_threshold)).drop("_length", "_end_pos")


def felt(i: Column, config: OverlayConfig, of: Column | None = None) -> Column:
    """The factor at row ``i`` of an effect, at the origin or upstream; its parameters are columns, or fields of ``of``."""
    get = F.col if of is None else (lambda name: of[name])
    factor = multiplier(i, get("n"), get("magnitude"), of)
    return F.when(get("hops") == 0, factor).otherwise(inherited(factor, get("hops"), config.attenuation))


def incident_id(ordinal: Column) -> Column:
    return F.when(ordinal.isNotNull(), F.format_string("INC-%04d", ordinal.cast("long")))


def apply_faults(
    grid: DataFrame, effect_rows: DataFrame, config: OverlayConfig = OverlayConfig()
) -> DataFrame:
    """The grid with values multiplied and clipped, ``is_anomalous`` and ``incident_id``.

    Overlapping faults multiply; a cell belongs to the first fault (by ordinal) that deviates beyond
    the threshold there. The grid meets a row per (series, block of positions) that holds what changes there: effects that still climb or
    decay, and stretches over which the product of all others is one number. The grid is shuffled once at most.
    """
    cells = grid.withColumn("_block", F.expr(f"pos div {_BLOCK}"))
    joined = cells.join(_by_block(effect_rows, config), [*SERIES, "_block"], "left")
    pos = F.col("pos")

    def here(e: Column) -> Column:
        return (pos >= e["from_pos"]) & (pos < e["until"])

    def moved(e: Column) -> Column:
        factor = felt((pos - e["from_pos"]).cast("double"), config, e)
        return F.struct(factor.alias("factor"), F.when(F.abs(factor - 1) > config.effect_threshold, e["ordinal"]).alias("first"))

    steady = F.transform(F.filter("_steady", here), lambda e: F.struct(e["factor"].alias("factor"), e["first"].alias("first")))
    found = F.concat(F.transform(F.filter("_moving", here), moved), steady)
    hit = joined.withColumn("_hit", found)
    factor = F.aggregate("_hit", F.lit(1.0), lambda product, e: product * e["factor"])
    hit = hit.withColumns({"_factor": factor, "_first": F.array_min(F.transform("_hit", lambda e: e["first"]))})
    changed = within_bounds(F.col("metric"), F.col("value") * F.coalesce("_factor", F.lit(1.0)))
    return hit.select(
        *[changed.alias("value") if c == "value" else F.col(c) for c in grid.columns],
        F.col("_first").isNotNull().alias("is_anomalous"),
        F.coalesce(incident_id(F.col("_first")), F.lit("")).alias("incident_id"),
    )


def _by_block(effect_rows: DataFrame, config: OverlayConfig) -> DataFrame:
    """Per series and block the effects that are ``_moving`` there and the ``_steady`` stretches, which do not overlap.

    A fault without end is moving for its ramp only; after that it is one more factor of the stretches behind.
    """
    rows = effect_rows.withColumn("_moves", F.least("length", moving_rows(F.col("n"))))
    settled = F.col("from_pos") + F.col("_moves")
    last = felt(ramp_steps(F.col("n")), config)
    constant = rows.where(F.col("_moves") < F.col("length")).select(
        *SERIES,
        settled.alias("from_pos"),
        (F.col("from_pos") + F.col("length")).alias("until"),
        last.alias("factor"),
        F.when(F.abs(last - 1) > config.effect_threshold, F.col("ordinal")).alias("first"),
    )
    steady = settle(constant, SERIES, "from_pos", "until", {"factor": F.product, "first": F.min})
    parameters = ["ordinal", "n", "magnitude", "hops", "from_pos", "until", "ramp", "floor", "half_life", "gain", "power", "offset"]
    moving = rows.withColumn("until", settled)
    kinds = {"_moving": (moving, parameters), "_steady": (steady, ["from_pos", "until", "factor", "first"])}
    blocks = F.explode(F.sequence(F.expr(f"from_pos div {_BLOCK}"), F.expr(f"(until - 1) div {_BLOCK}"))).alias("_block")
    spread = [table.select(*SERIES, blocks, F.struct(*fields).alias(name)) for name, (table, fields) in kinds.items()]
    both = spread[0].unionByName(spread[1], allowMissingColumns=True)
    # what changes within one block of one series
    return both.groupBy(*SERIES, "_block").agg(*[F.collect_list(name).alias(name) for name in kinds])


def incident_records(
    faults: DataFrame, grid: DataFrame, hops: DataFrame, config: OverlayConfig = OverlayConfig()
) -> DataFrame:
    """Ground truth of an overlay: one row per fault with the services it visibly touches."""
    axis = axis_of(grid)
    emitted = grid.select(*SERIES).distinct()
    visible = (
        effects(faults, axis, hops, config)
        .where(F.col("peak") > config.effect_threshold)
        .join(emitted, SERIES, "left_semi")
        .groupBy("ordinal")
        .agg(F.array_sort(F.collect_set("service")).alias("affected_services"))
    )
    final = axis.agg(F.max("timestamp").alias("t")).scalar()
    rows = fault_windows(faults, axis).join(visible, "ordinal", "left")
    return rows.select(
        "ordinal",
        incident_id(F.col("ordinal")).alias("incident_id"),
        "kind",
        F.col("service").alias("root_service"),
        "start",
        F.when(F.col("permanent"), final).otherwise(F.col("end")).alias("end"),
        "magnitude",
        "permanent",
        F.coalesce("affected_services", F.array().cast("array<string>")).alias("affected_services"),
    )
