"""Order MinHash: fingerprints of texts that follow edit distance, order included.

Every k-mer of code points is numbered by how often it occurred before, so that repeats count. Each of
``slots`` hash functions picks the ``tuple_size`` k-mers with the smallest values, puts them back into
text order and hashes the tuple. The share of equal slots of two fingerprints estimates a likeness that falls
when k-mers are missing and also when they stand in another order.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from sparkwatch.llm.common import mix, texts_of

_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_STRIDE = 8192
_PACKED = 20
#: Stretches of ids per task of the shuffle.
STRETCHES = 8


@dataclass(frozen=True)
class OrderMin:
    """k-mers of ``k`` code points, ``slots`` tuples of ``tuple_size`` k-mers each."""

    k: int = 6
    slots: int = 64
    tuple_size: int = 2
    seed: int = 17

    def _functions(self) -> tuple[np.ndarray, np.ndarray]:
        draw = np.random.default_rng(self.seed).integers(0, 1 << 32, (2, self.slots), dtype=np.uint32)
        return draw[0] | np.uint32(1), draw[1]

    def of(self, text: str) -> np.ndarray:
        """``slots`` 32-bit values; all zero for an empty text."""
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
        if not len(points):
            return np.zeros(self.slots, np.uint32)
        if len(points) < self.k:  # a shorter text is one k-mer
            points = np.concatenate((points, np.zeros(self.k - len(points), np.uint64)))
        n = len(points) - self.k + 1
        kmers = np.zeros(n, np.uint64)
        for i in range(self.k):
            kmers = kmers * _FACTOR + points[i : i + n] + np.uint64(1)
        kmers = mix(kmers)
        if n < self.tuple_size:  # too few k-mers for a tuple: they occur again
            kmers = np.resize(kmers, self.tuple_size)
        numbered = (mix(kmers + _occurrences(kmers) * _FACTOR) >> np.uint64(32)).astype(np.uint32)
        at = np.sort(self._smallest(numbered), axis=1)
        made = np.zeros(self.slots, np.uint64)
        for i in range(self.tuple_size):
            made = mix(made * _FACTOR + kmers[at[:, i]] + np.uint64(1))
        return (made >> np.uint64(32)).astype(np.uint32)

    def _smallest(self, values: np.ndarray) -> np.ndarray:
        """Positions of the smallest values under each function, found stretch by stretch."""
        factor, flip = self._functions()
        rows = np.arange(self.slots)
        best = places = None
        for start in range(0, len(values), _STRIDE):
            seen = (values[None, start : start + _STRIDE] ^ flip[:, None]) * factor[:, None]
            found_at, found = [], []
            for _ in range(min(self.tuple_size, seen.shape[1])):
                i = seen.argmin(axis=1)
                found_at.append(i + start)
                found.append(seen[rows, i].astype(np.uint64))
                seen[rows, i] = 0xFFFFFFFF
            found_at, found = np.stack(found_at, 1), np.stack(found, 1)
            if best is not None:
                found_at, found = np.concatenate((places, found_at), 1), np.concatenate((best, found), 1)
            keep = np.argsort(found, axis=1, kind="stable")[:, : self.tuple_size]
            best, places = np.take_along_axis(found, keep, 1), np.take_along_axis(found_at, keep, 1)
        return places


def _occurrences(kmers: np.ndarray) -> np.ndarray:
    """For each k-mer, how many equal ones stand before it."""
    n = len(kmers)
    if n <= 1 << _PACKED:  # hash and position in one word: sorting values is faster than sorting positions
        low = np.uint64((1 << _PACKED) - 1)
        packed = np.sort((kmers & ~low) | np.arange(n, dtype=np.uint64))
        order, ranked = (packed & low).astype(np.int64), packed >> np.uint64(_PACKED)
    else:
        order = np.argsort(kmers, kind="stable")
        ranked = kmers[order]
    index = np.arange(n)
    first = np.concatenate(([True], ranked[1:] != ranked[:-1]))
    out = np.empty(n, np.uint64)
    out[order] = index - np.maximum.accumulate(np.where(first, index, 0))
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal slots, 0 to 1."""
    return float(np.mean(a == b))


def as_text(fingerprint: np.ndarray) -> str:
    return fingerprint.astype(">u4").tobytes().hex()


def fingerprints(df: DataFrame, text: str = "text", out: str = "fingerprint", spec: OrderMin = OrderMin()) -> DataFrame:
    """``df`` with ``out``: eight hexadecimal digits per slot. A missing text counts as empty; equal texts get equal values.

    A column named ``out`` is replaced; all others stay.
    """

    def made(column: pa.Array) -> pa.Array:
        return pa.array([as_text(spec.of(x)) for x in texts_of(column)], pa.string())

    return df.withColumn(out, F.arrow_udf(made, "string")(F.col(text)))


def fingerprint_likeness(a: Column, b: Column, slots: int) -> Column:
    """Share of equal slots of two fingerprint columns, without Python."""
    same = F.transform(F.sequence(F.lit(0), F.lit(slots - 1)), lambda i: (F.substr(a, i * 8 + 1, F.lit(8)) == F.substr(b, i * 8 + 1, F.lit(8))).cast("int"))
    return F.aggregate(same, F.lit(0), lambda x, y: x + y) / F.lit(float(slots))


_REPORT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edited_report(df: DataFrame, doc_id: str = "doc_id", text: str = "text", spec: OrderMin = OrderMin()) -> DataFrame:
    """Each document against its edited text and against the next document, by descending id.

    The edited text has the last half (rounded down) of the code points replaced by the first as many, or all, of the next document;
    after the last document comes the first. Missing texts are empty, missing ids come last, repeated ids are ordered by text.
    One document alone is its own next.

    Texts are shuffled once, into stretches of ids whose bounds are quantiles of the id column. Each stretch also
    gets the first document of the next one, and is read in order with one document in hand.
    """
    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    spark = df.sparkSession
    tasks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    n = STRETCHES * tasks  # several to a task, since stretches are dealt by hash
    cuts = rows.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)] or [0.5], 100 * n)).first()[0]
    bounds = np.unique(np.array(cuts or [0], np.int64))

    def bucket(ids: pa.Array) -> pa.Array:
        missing = ids.is_null().to_numpy(zero_copy_only=False)
        found = np.searchsorted(bounds, ids.fill_null(0).to_numpy(zero_copy_only=False), "right")
        return pa.array(np.where(missing, 0, found).astype(np.int32))

    placed = rows.withColumn("bucket", F.arrow_udf(bucket, "int")(F.col("doc_id")))
    # as many rows as stretches
    firsts = {r["bucket"]: r["top"] for r in placed.groupBy("bucket").agg(F.max("doc_id").alias("top")).collect()}
    if not firsts:
        return spark.createDataFrame([], _REPORT)
    down = sorted(firsts, reverse=True)
    target = [(b, a) for a, b in zip(down, down[1:] + down[:1])]
    wanted = [v for v in firsts.values() if v is not None]
    heads = placed.where(F.col("doc_id").isin(wanted) | F.col("doc_id").isNull())
    heads = heads.groupBy("bucket").agg(F.max(F.struct("doc_id", "text")).alias("head"))
    halo = heads.join(F.broadcast(spark.createDataFrame(target, "bucket int, to int")), "bucket").select(
        F.col("head.doc_id").alias("doc_id"), F.col("head.text").alias("text"), F.col("to").alias("bucket"), F.lit(1).alias("halo")
    )
    # a bucket holds one n-th of the ids and is read as a stream
    dealt = placed.withColumn("halo", F.lit(0)).unionByName(halo).repartition(tasks, "bucket")
    ordered = dealt.sortWithinPartitions("bucket", "halo", F.desc_nulls_last("doc_id"), F.desc_nulls_last("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            out = []
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text")
            halos = batch.column("halo").to_pylist()
            for i, at in enumerate(ids):
                here = texts[i].as_py() or ""
                print_here = spec.of(here)
                if held is not None:
                    out.append(_line(spec, *held, here, print_here))
                held = None if halos[i] else (at, here, print_here)
            yield pa.RecordBatch.from_pylist(out, schema=_ARROW)

    return ordered.mapInArrow(run, _REPORT)


_ARROW = pa.schema(
    [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string())]
    + [("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
)


def _line(spec: OrderMin, doc_id, text: str, own: np.ndarray, following: str, following_print: np.ndarray) -> dict:
    half = len(text) // 2
    edited = text[: len(text) - half] + following[:half]
    changed = spec.of(edited)
    return {
        "doc_id": doc_id,
        "n_chars": len(text),
        "edited_sha256": hashlib.sha256(edited.encode()).hexdigest(),
        "fingerprint": as_text(own),
        "edited_fingerprint": as_text(changed),
        "near_edited": likeness(own, changed),
        "near_next": likeness(own, following_print),
    }
