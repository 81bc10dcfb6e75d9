"""Mixing sources to target weights by Sainte-Laguë apportionment.

Sources get shares of all words by weight, limited to ``epochs`` times what they have. The shares are handed
out as blocks of equal size: first to sources, then within a source to its shards, each time by the highest
quotients ``votes / (2 seats + 1)``. A shard's documents stand in a seeded order, its blocks are consecutive
runs of words of that order repeated without end, and it takes as many consecutive blocks as it was
given, beginning with a seeded one. So a document is taken whole a number of times, and at most
the documents at the ends of the run in part.

Only three tables are ordered as a whole, and they have one row per source; shards hold a bounded number of documents
whatever their source holds. Texts are not moved.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window, functions as F

from sparkwatch.llm.common import WORD, free_name
from sparkwatch.session import stored


@dataclass(frozen=True)
class Mix:
    weights: tuple[float, ...] = (1.0, 2.0, 3.0)
    epochs: int = 3
    #: Words of a block. Only quotients near a source's share are ranked, so blocks of one word cost no more than larger ones.
    block: int = 1
    shard_documents: int = 4096
    seed: int = 11


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def targets(sources: DataFrame, spec: Mix = Mix()) -> DataFrame:
    """``source, source_size`` with ``weight`` and ``target``.

    Sources in code point order, the missing one last, take the weights in turn. Their shares of the total are proportional to the
    weights except that none is above ``epochs`` times its size; what exceeds that goes to the others by weight.
    """
    place = F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1
    weight = F.get(F.array(*[F.lit(float(w)) for w in spec.weights]), place % len(spec.weights))
    limit = F.col("source_size") * F.lit(float(spec.epochs))
    rows = sources.withColumn("weight", weight).withColumn("_limit", limit).withColumn("_full_at", F.col("_limit") / F.col("weight"))
    # by the level at which a source is full: those before a source are full when the level reaches it
    everything = Window.orderBy("_full_at", F.asc_nulls_last("source"))
    whole = everything.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = everything.rowsBetween(Window.unboundedPreceding, -1)
    left = F.sum(F.col("source_size").cast("double")).over(whole) - F.coalesce(F.sum("_limit").over(before), F.lit(0.0))
    open_weight = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    rows = rows.withColumn("_level", left / open_weight).withColumn("_full", F.col("_full_at") <= F.col("_level"))
    # past the first source that is not full the trial levels fall
    level = F.max(F.when(~F.col("_full"), F.col("_level"))).over(whole)
    target = F.when(F.col("_full"), F.col("_limit")).otherwise(level * F.col("weight"))
    return rows.withColumn("target", target).drop("_limit", "_full_at", "_level", "_full")


def apportion(df: DataFrame, group: list[str], item: str, votes: str, seats: str, out: str) -> DataFrame:
    """``df`` with ``out``: whole seats per item by the highest quotients votes / (2 seats + 1), within each group.

    Ties go to the smaller item. A group without votes gives no seats. ``seats`` is the group's number, on each of its rows.

    Rounded shares differ from the result by few seats, so only the quotients near them are ranked: with n items an item's
    seats move by at most 1 + 1.5 n times its share of the votes, which makes fewer than 5 n quotients in all.
    """
    each = Window.partitionBy(*[F.col(c) for c in group]) if group else Window.partitionBy(F.lit(0))
    total, n = F.sum(F.col(votes).cast("double")).over(each), F.count(F.lit(1)).over(each)
    share = F.when(total > 0, F.col(votes) / total).otherwise(F.lit(0.0))
    rows = df.withColumn("_share", share).withColumn("_near", F.ceil(n * share * 1.5).cast("long") + 2)
    rows = rows.withColumn("_start", F.floor(F.col("_share") * F.col(seats) + 0.5).cast("long"))
    rows = rows.withColumn("_missing", F.when(total > 0, F.col(seats) - F.sum("_start").over(each)).otherwise(F.lit(0)).cast("long"))
    step = F.explode(F.sequence(F.lit(0).cast("long"), F.col("_near"))).alias("_step")
    tried = rows.where(F.col("_missing") != 0).select(*group, item, votes, "_start", "_missing", step)
    up = F.col("_missing") > 0
    divisor = F.when(up, 2 * (F.col("_start") + F.col("_step")) + 1).otherwise(2 * (F.col("_start") - F.col("_step")) - 1)
    tried = tried.withColumn("_quotient", F.col(votes) / divisor).where(divisor > 0)
    # seats are added from the highest quotient down, or taken back from the lowest up
    order = F.when(up, -F.col("_quotient")).otherwise(F.col("_quotient"))
    tie = [F.asc_nulls_last(F.when(up, F.col(item))), F.desc_nulls_first(F.when(~up, F.col(item)))]
    ranked = Window.partitionBy(*[F.col(c) for c in group] or [F.lit(0)]).orderBy(order, *tie, "_step")
    chosen = tried.withColumn("_rank", F.row_number().over(ranked)).where(F.col("_rank") <= F.abs("_missing"))
    moved = chosen.groupBy(*[F.col(c).alias(f"_m_{c}") for c in (*group, item)]).agg((F.count(F.lit(1)) * F.signum(F.first("_missing"))).cast("long").alias("_moved"))
    same = [rows[c].eqNullSafe(moved[f"_m_{c}"]) for c in (*group, item)]
    condition = same[0]
    for other in same[1:]:
        condition = condition & other
    joined = rows.join(moved, condition, "left")
    return joined.withColumn(out, F.col("_start") + F.coalesce("_moved", F.lit(0).cast("long"))).select(*df.columns, out)


def mix(df: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", spec: Mix = Mix()) -> DataFrame:
    """One row per document: ``doc_id, source, size, source_size, weight, target, taken`` and the parts that are taken.

    ``size`` counts the words of the text (0 if it is missing). ``rounds`` whole copies are taken, then the words from ``part_from``
    to ``part_to`` and those before ``wrap_to`` (all 0 if none). Nothing else is read, so other columns may have any name. Repeated
    rows are documents of their own; a missing source is a source; missing ids only share a shard. An empty table gives no rows.
    """
    sized = stored(df.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size")))
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("_n"))
    aimed = targets(totals, spec)
    blocks = F.round(F.sum("target").over(Window.partitionBy(F.lit(0))) / spec.block).cast("long")
    quotas = stored(apportion(aimed.withColumn("_all", blocks), [], "source", "target", "_all", "_quota"))

    # --- shards of a bounded number of documents
    shards = F.ceil(F.col("_n") / F.lit(spec.shard_documents)).cast("long")
    draw = F.xxhash64(F.lit(spec.seed), F.col("doc_id").cast("string"), F.col("size"))
    known = quotas.withColumnRenamed("source", "_source")
    placed = sized.join(known, sized["source"].eqNullSafe(known["_source"])).drop("_source")
    placed = placed.withColumn("_draw", draw).withColumn("_shard", F.pmod(F.col("_draw"), shards))
    placed = stored(placed)
    held = placed.groupBy("source", "_shard").agg(F.sum("size").alias("_words"), F.first("_quota").alias("_quota"))
    given = apportion(held, ["source"], "_shard", "_words", "_quota", "_blocks")
    taken = F.least(F.col("_blocks") * spec.block, F.col("_words") * spec.epochs)
    begin = F.pmod(F.xxhash64(F.lit(spec.seed), "source", "_shard"), F.greatest(F.floor(F.col("_words") / spec.block), F.lit(1))) * spec.block
    given = given.withColumn("_taken", taken).where(F.col("_words") > 0).select(
        F.col("source").alias("_g_source"),
        F.col("_shard").alias("_g_shard"),
        "_words",
        F.floor(F.col("_taken") / F.col("_words")).cast("long").alias("_rounds"),
        F.pmod(F.col("_taken"), F.col("_words")).alias("_rest"),
        begin.cast("long").alias("_begin"),
    )

    # --- documents in the seeded order of their shard
    order = Window.partitionBy("source", "_shard").orderBy(F.xxhash64(F.lit(spec.seed + 1), "_draw"), "doc_id", "size")
    end = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))
    placed = placed.withColumn("_end", end).withColumn("_start", F.col("_end") - F.col("size"))
    rows = placed.join(given, placed["source"].eqNullSafe(given["_g_source"]) & (F.col("_shard") == F.col("_g_shard")), "left")
    zero = F.lit(0).cast("long")
    stop = F.col("_begin") + F.col("_rest")
    low, high = F.greatest(F.col("_start"), F.col("_begin")), F.least(F.col("_end"), stop)
    wrap = F.greatest(F.least(F.col("_end"), stop - F.col("_words")) - F.col("_start"), zero)
    rows = rows.select(
        "doc_id",
        "source",
        "size",
        "source_size",
        "weight",
        "target",
        F.coalesce("_rounds", zero).alias("rounds"),
        F.when(high > low, low - F.col("_start")).otherwise(zero).alias("part_from"),
        F.when(high > low, high - F.col("_start")).otherwise(zero).alias("part_to"),
        F.coalesce(wrap, zero).alias("wrap_to"),
    )
    taken = F.col("rounds") * F.col("size") + F.col("part_to") - F.col("part_from") + F.col("wrap_to")
    return rows.withColumn("taken", taken)


_WORDS = regex.compile(WORD)


def taken_text(text: str, rounds: int, part_from: int, part_to: int, wrap_to: int) -> str:
    """What a mix takes of one text: whole copies, then a stretch of words, then words from its start, line by line."""
    parts = [text] * rounds
    stretches = [s for s in ((part_from, part_to), (0, wrap_to)) if s[1] > s[0]]
    if stretches:
        spans = [m.span() for m in _WORDS.finditer(text)]
        parts += [text[spans[a][0] : spans[b - 1][1]] for a, b in stretches]
    return "\n".join(parts)


def apply_mix(df: DataFrame, mixed: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``df`` with its texts as mixed; documents of which nothing is taken go. Each row has the decision of one row of ``mixed``.

    An id that stands once finds its decision by the id. Rows that share an id, or have none, are paired with decisions of their own source
    and size, in the order of the texts' hashes; such decisions fit each of those texts. Texts taken once and whole do not leave the JVM.
    """
    parts = ["rounds", "part_from", "part_to", "wrap_to"]
    own, part, key, place = (free_name(df, c) for c in ("_id_of_parts", "_parts", "_alike", "_place"))
    mixed = stored(mixed.select("doc_id", "source", "size", "taken", F.struct(*parts).alias(part)))
    by_id = stored(mixed.groupBy(F.col("doc_id").alias(own)).agg(F.count(F.lit(1)).alias("_n"), F.first(part).alias(part), F.max("taken").alias("_taken")))

    def cut(texts: pa.Array, plans: pa.Array) -> pa.Array:
        made = []
        for x, p in zip(texts.to_pylist(), plans.to_pylist()):
            made.append(None if x is None else taken_text(x, *[p[k] for k in parts]))
        return pa.array(made, pa.string())

    known = by_id.where((F.col("_n") == 1) & (F.col("_taken") > 0)).select(own, part)
    rows = df.join(known, F.col(doc_id).eqNullSafe(F.col(own))).select(*df.columns, part)

    # --- ids of several rows: structs are equal where the same fields are missing
    shared = by_id.where(F.col("_n") > 1).select(own)
    alike = df.join(shared, F.col(doc_id).eqNullSafe(F.col(own)), "left_semi")
    alike = alike.withColumn(key, F.struct(F.col(doc_id).alias("i"), F.col(source).alias("s"), word_count(F.col(text)).alias("n")))
    alike = alike.withColumn(place, F.row_number().over(Window.partitionBy(key).orderBy(F.xxhash64(text), F.col(text))))
    plans = mixed.join(shared, F.col("doc_id").eqNullSafe(F.col(own)), "left_semi")
    plans = plans.select(F.struct(F.col("doc_id").alias("i"), F.col("source").alias("s"), F.col("size").alias("n")).alias(key), part, "taken")
    plans = plans.withColumn(place, F.row_number().over(Window.partitionBy(key).orderBy(part)))
    plans = plans.where(F.col("taken") > 0).select(key, place, part)
    rows = rows.unionByName(alike.join(plans, [key, place]).select(*df.columns, part))

    once = (F.col(f"{part}.rounds") == 1) & (F.col(f"{part}.part_to") == 0) & (F.col(f"{part}.wrap_to") == 0)
    changed = F.arrow_udf(cut, "string")(F.when(~once, F.col(text)), F.col(part))
    return rows.withColumn(text, F.when(once, F.col(text)).otherwise(changed)).select(*df.columns)
