"""Exact Jaccard self-join on word n-grams by rare-first prefix filtering, and the components of its links.

1. N-grams are hashed to 64 bits and ordered rare-first, by counts over the whole corpus in a table of fixed size; the order is
   written into the hashes themselves. Two sets of sizes x and y can only reach the similarity t if they share t / (1 + t) (x + y)
   n-grams, hence one within the first x - that + 1 of one set and y - that + 1 of the other.
2. Equal sets are one class, represented by its smallest id. Only n-grams that two documents have in their prefixes go on.
3. Pairs that share a prefix n-gram pass a length filter, a positional filter (enough n-grams stand at or behind the match) and a
   suffix filter: both sets are cut into the same parts, and what the parts differ in size is part of what the sets differ
   in. There are few parts along the order, with their sizes, and many by hash, of which it is enough to know whether
   their sizes are odd. What is left is verified once per pair on the whole texts.
4. Only links between different components can change the components. As long as that halves the pairs between components, each
   list picks pivots, each document is verified against the one pivot with which it shares most n-grams, and lists within one
   component are done. This is linear in the lists and unites groups of near copies. Then all remaining pairs between
   different components are compared. No pair that could link two components is left out, and no group of copies is ever
   expanded into all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from sparkwatch.llm.common import maybe_in, mix, over_batches, texts_of, words_by_text
from sparkwatch.llm.components import components
from sparkwatch.session import discard, stored

_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_OTHER = np.uint64(0xC2B2AE3D27D4EB4F)


@dataclass(frozen=True)
class JaccardJoin:
    """Sets of ``size``-word n-grams link at a similarity of ``percent`` or more."""

    size: int = 5
    percent: int = 80
    #: The count table has 2^count_bits entries, the id filter 2^filter_bits bits: fixed sizes, sent to every executor.
    count_bits: int = 18
    filter_bits: int = 25
    #: Parts that the suffix filter compares: along the order, and by hash (a power of two, at least 64).
    parts: int = 32
    odd_parts: int = 2048
    #: Pivots of a list, and pairs per list entry up to which all pairs are compared directly.
    pivots: int = 2
    direct: float = 1.0

    def needed(self, both: Column) -> Column:
        """Least number of shared n-grams of two sets with so many together."""
        return F.ceil(both * self.percent / F.lit(100 + self.percent))


def grams(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of a text's n-grams, sorted and distinct; the whole text is one if it has fewer words."""
    if not len(words):
        return words
    width = min(size, len(words))
    rolled = np.zeros(len(words) - width + 1, np.uint64)
    for i in range(width):
        rolled = rolled * _FACTOR + words[i : len(words) - width + 1 + i]
    ranked = np.sort(mix(rolled + np.uint64(width)))
    return ranked[np.concatenate(([True], ranked[1:] != ranked[:-1]))]


def _sets(column, size: int) -> Iterator[np.ndarray]:
    for _, words in words_by_text([t.encode().lower() for t in texts_of(column)]):
        yield grams(words, size)


def _counts(rows: DataFrame, spec: JaccardJoin) -> np.ndarray:
    """How many documents have an n-gram in each bin of hashes. Every task adds up its own bins; the table has a fixed size."""
    shift, n = np.uint64(64 - spec.count_bits), 1 << spec.count_bits

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, waiting, size = np.zeros(n, np.int64), [], 0
        for batch in batches:
            for found in _sets(batch.column("text"), spec.size):
                waiting.append(found >> shift)
                size += len(found)
                if size > n:
                    held += np.bincount(np.concatenate(waiting).astype(np.int64), minlength=n)
                    waiting, size = [], 0
        if waiting:
            held += np.bincount(np.concatenate(waiting).astype(np.int64), minlength=n)
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(held[some])], ["bin", "n"])

    summed = rows.select("text").mapInArrow(count, "bin int, n long").groupBy("bin").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(n, np.int64)
    out[summed["bin"].to_numpy()] = summed["n"].to_numpy()
    return out


class Order:
    """Rare-first order of hashes, as a permutation of their leading bits; the rest of the hash breaks ties."""

    def __init__(self, counts: np.ndarray, parts: int):
        self.bits = int(len(counts)).bit_length() - 1
        self.rank = np.empty(len(counts), np.uint64)
        order = np.argsort(counts, kind="stable")
        self.rank[order] = np.arange(len(counts), dtype=np.uint64)
        # cuts of the order into parts with equal numbers of n-grams
        running = np.cumsum(counts[order])
        at = np.searchsorted(running, running[-1] * np.arange(1, parts) / parts)
        self.cuts = at.astype(np.uint64) << np.uint64(64 - self.bits)

    def keys(self, found: np.ndarray) -> np.ndarray:
        low = np.uint64(64 - self.bits)
        return np.sort((self.rank[(found >> low).astype(np.int64)] << low) | (found & np.uint64((1 << (64 - self.bits)) - 1)))

    def parts(self, keys: np.ndarray) -> np.ndarray:
        return np.diff(np.concatenate(([0], np.searchsorted(keys, self.cuts), [len(keys)])))


def _lists(values: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    offsets = np.cumsum([0, *map(len, values)])
    flat = np.concatenate(values) if values else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(flat, kind))


def _profiles(rows: DataFrame, order, spec: JaccardJoin) -> DataFrame:
    """Per document: the size of its set, a 128-bit hash of it, the sizes of its parts along the order, which of its parts by hash
    are odd, and its prefix, rarest n-gram first."""

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        by = order.value
        sizes, first, second, parts, odd, prefixes = [], [], [], [], [], []
        for found in _sets(batch.column("text"), spec.size):
            keys = by.keys(found)
            n = len(keys)
            sizes.append(n)
            first.append(mix(found).sum(dtype=np.uint64))
            second.append(mix(found ^ _OTHER).sum(dtype=np.uint64))
            parts.append(by.parts(keys).astype(np.int32))
            spots = (found & np.uint64(spec.odd_parts - 1)).astype(np.int64)
            odd.append(np.packbits((np.bincount(spots, minlength=spec.odd_parts) & 1).astype(bool)).view(np.int64))
            prefixes.append(keys[: n - -(-n * spec.percent // 100) + 1].view(np.int64) if n else np.zeros(0, np.int64))
        columns = [batch.column("doc_id"), pa.array(sizes, pa.int32()), pa.array(np.array(first, np.uint64).view(np.int64)), pa.array(np.array(second, np.uint64).view(np.int64))]
        return pa.RecordBatch.from_arrays([*columns, _lists(parts, pa.int32()), _lists(odd, pa.int64()), _lists(prefixes, pa.int64())], ["doc_id", "n", "ka", "kb", "parts", "odd", "prefix"])

    return over_batches(rows, work, "doc_id long, n int, ka long, kb long, parts array<int>, odd array<long>, prefix array<long>")


def _passing(spec: JaccardJoin) -> Column:
    """Length and positional filter of a match at positions ``pos`` and ``_pos`` of sets of sizes ``n`` and ``_n``."""
    n, m = F.col("n"), F.col("_n")
    need = spec.needed(n + m)
    return (F.least(n, m) * 100 >= F.greatest(n, m) * spec.percent) & (n - F.col("pos") >= need) & (m - F.col("_pos") >= need)


def _total(each: Column) -> Column:
    return F.aggregate(each, F.lit(0), lambda s, x: s + x)


def _folded(words: int = 4) -> Column:
    """``odd`` with its parts thrown together into fewer ones, whose sizes are odd if an odd number of theirs are."""
    each = F.size("odd") / words
    zero = F.lit(0).cast("long")
    parts = [F.slice("odd", (F.greatest(each, F.lit(1)) * i).cast("int") + 1, F.ceil(each).cast("int")) for i in range(words)]
    return F.array(*[F.aggregate(p, zero, lambda s, x: s.bitwiseXOR(x)) for p in parts])


def _underscored(df: DataFrame, *names: str) -> DataFrame:
    return df.select("g", *[F.col(c).alias(f"_{c}") for c in names])


def _verified(pairs: DataFrame, profiles: DataFrame, texts: DataFrame, spec: JaccardJoin) -> DataFrame:
    """``a, b, linked`` of the pairs that pass the suffix filter, by the whole texts."""
    left = profiles.select(F.col("doc_id").alias("a"), *[F.col(c).alias(f"{c}_a") for c in ("n", "parts", "odd")])
    right = profiles.select(F.col("doc_id").alias("b"), *[F.col(c).alias(f"{c}_b") for c in ("n", "parts", "odd")])

    apart = _total(F.zip_with("parts_a", "parts_b", lambda x, y: F.abs(x - y)))
    uneven = _total(F.zip_with("odd_a", "odd_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))))
    both = F.col("n_a") + F.col("n_b")
    near = pairs.join(left, "a").join(right, "b").where(F.greatest(apart, uneven) <= both - 2 * spec.needed(both)).select("a", "b")
    text_a = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    text_b = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    rows = near.join(text_a, "a").join(text_b, "b").select("a", "b", "text_a", "text_b")

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        linked, last = [], (None, None)
        for i, b in enumerate(batch.column("b").to_pylist()):
            x = next(_sets(batch.column("text_a").slice(i, 1), spec.size))
            if last[0] != b:  # rows come ordered by b
                last = (b, next(_sets(batch.column("text_b").slice(i, 1), spec.size)))
            shared = len(np.intersect1d(x, last[1], assume_unique=True))
            linked.append(100 * shared >= spec.percent * (len(x) + len(last[1]) - shared))
        return pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(linked, pa.bool_())], ["a", "b", "linked"])

    return over_batches(rows, work, "a long, b long, linked boolean")


def _texts_of_ids(rows: DataFrame, ids: DataFrame, spec: JaccardJoin) -> DataFrame:
    """The texts of some ids; a bitmap keeps most others out of the shuffle."""
    return maybe_in(rows, "doc_id", ids, spec.filter_bits).join(ids, "doc_id", "left_semi")


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", spec: JaccardJoin = JaccardJoin()) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id``.

    A-Z are lower-cased, words stand between ASCII white space. A document with fewer words than an n-gram has one, the whole sequence; one without
    words (or text) has none and is its own component. ``component_id`` is the smallest id that links lead to. Rows with a missing id
    count as copies of equal sets; without any id in their class they have no component. Rows that share an id should share a
    text: if they differ, links of either count for the id. Other columns are not read.
    """
    spark = df.sparkSession
    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    order = spark.sparkContext.broadcast(Order(_counts(rows, spec), spec.parts))
    profiles = stored(_profiles(rows, order, spec))
    classes = stored(profiles.where("n > 0").groupBy("n", "ka", "kb").agg(F.min("doc_id").alias("rep")))
    rooted = _links(rows, profiles, classes, spec)
    out = profiles.select("doc_id", "n", "ka", "kb").join(classes, ["n", "ka", "kb"], "left")
    if rooted is not None:
        out = out.join(rooted.select(F.col("node").alias("rep"), "root"), "rep", "left")
    else:
        out = out.withColumn("root", F.lit(None).cast("long"))
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("root", "rep", "doc_id").alias("component_id"))


def _links(rows: DataFrame, profiles: DataFrame, classes: DataFrame, spec: JaccardJoin) -> DataFrame | None:
    """``node, root`` of the representatives that link with another, or None if there are none."""
    postings = profiles.select("doc_id", "n", F.posexplode("prefix").alias("pos", "g"))
    common = postings.groupBy("g").agg(F.count(F.lit(1)).alias("_c")).where("_c > 1").select("g")
    reps = classes.select(F.col("rep").alias("doc_id"))
    entries = stored(postings.join(common, "g", "left_semi").join(reps, "doc_id", "left_semi"))
    texts = roots = checked = None
    round_, before = 0, float("inf")
    own = ("doc_id", "n", "pos", "root")
    while True:
        # --- lists that still hold more than one component
        known = entries.drop("root")
        known = known.withColumn("root", F.col("doc_id")) if roots is None else known.join(roots.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("root", F.coalesce("root", "doc_id"))
        # every other pivot is the document in most lists: of near copies the least changed one, to which most others link
        known = known.join(known.groupBy("doc_id").agg((-F.count(F.lit(1))).alias("w")), "doc_id")
        weights = [F.col("w") if i % 2 == 0 else F.lit(0).cast("long").alias("w") for i in range(spec.pivots)]
        best = [F.min(F.struct(w, F.xxhash64(F.lit(spec.pivots * round_ + i), "doc_id").alias("h"), *own)).alias(f"p{i}") for i, w in enumerate(weights)]
        per_root = known.groupBy("g", "root").agg(F.count(F.lit(1)).alias("c"), *best)
        picked = F.array(*[F.min(f"p{i}") for i in range(spec.pivots)]).alias("p")
        lists = per_root.groupBy("g").agg(F.sum("c").alias("m"), F.sum(F.col("c") * F.col("c")).alias("same"), F.count(F.lit(1)).alias("roots"), picked).where("roots > 1")
        lists = stored(lists.drop("roots"))
        totals = lists.agg(F.sum("m"), F.sum((F.col("m") * F.col("m") - F.col("same")) / 2)).first()
        if not totals[0]:
            return roots
        kept = stored(known.join(lists.select("g"), "g", "left_semi").select("g", *own))
        discard(entries)
        entries = kept
        last = totals[1] <= spec.direct * totals[0] or totals[1] > before / 2
        before = totals[1]
        if texts is None:
            texts = stored(_texts_of_ids(rows, entries.select("doc_id").distinct(), spec).dropDuplicates(["doc_id"]))

        # --- all pairs between components, or each document with the best of its lists' pivots
        if last:
            signed = entries.join(profiles.select("doc_id", _folded().alias("odd")), "doc_id")
            uneven = _total(F.zip_with("odd", "_odd", lambda x, y: F.bit_count(x.bitwiseXOR(y))))
            both = F.col("n") + F.col("_n")
            other = (F.col("doc_id") < F.col("_doc_id")) & (F.col("root") != F.col("_root"))
            found = signed.join(_underscored(signed, *own, "odd"), "g").where(other & _passing(spec) & (uneven <= both - 2 * spec.needed(both)))
        else:
            pivots = lists.select("g", F.explode("p").alias("p")).select("g", *[F.col(f"p.{c}").alias(f"_{c}") for c in own])
            found = entries.join(pivots, "g").where((F.col("root") != F.col("_root")) & _passing(spec))
        ends = [F.least("doc_id", "_doc_id").alias("a"), F.greatest("doc_id", "_doc_id").alias("b")]
        pairs = found.groupBy("doc_id", "_doc_id").agg(F.count(F.lit(1)).alias("shared")).select("doc_id", "shared", *ends)
        if checked is not None:
            pairs = pairs.join(checked.select("a", "b"), ["a", "b"], "left_anti")
        if not last:
            top = F.max(F.struct("shared", (-F.col("a")).alias("a"), (-F.col("b")).alias("b"))).alias("t")
            pairs = pairs.groupBy("doc_id").agg(top).select((-F.col("t.a")).alias("a"), (-F.col("t.b")).alias("b")).distinct()
        made = stored(_verified(pairs.select("a", "b"), profiles, texts, spec))
        links = made.where("linked").select("a", "b")
        checked = made if checked is None else checked.unionByName(made)
        if links.head(1):
            old = roots.select(F.col("node").alias("a"), F.col("root").alias("b")) if roots is not None else links.limit(0)
            roots = components(links.unionByName(old))
        discard(lists)
        round_ += 1
        if last:
            return roots
