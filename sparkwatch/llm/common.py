"""What several text operators share: Arrow passes over columns, words, hashes, vocabularies."""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Texts of one group that NumPy handles together, in bytes.
GROUP_BYTES = 1 << 18
SPACES = b" \t\n\x0b\x0c\r"
WORD = "[^\\x20\\x09-\\x0D]+"


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet")


def labels(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/labels.parquet")


def remainder(doc_id: Column, divisor: int) -> Column:
    """crc32 of the id's decimal digits modulo ``divisor``; an id that is missing counts as the empty string."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % divisor


def free_name(df: DataFrame, wish: str) -> str:
    """``wish``, with underscores in front as long as ``df`` has such a column."""
    taken = {c.lower() for c in df.columns}
    while wish.lower() in taken:
        wish = f"_{wish}"
    return wish


def over_batches(df: DataFrame, work: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """One output batch per Arrow batch, row counts free."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = work(batch)
            if made is not None:
                yield made

    return df.mapInArrow(run, schema)


def texts_of(column) -> list[str]:
    """Python strings of an Arrow column; a missing text is empty."""
    return [x or "" for x in column.to_pylist()]


def groups(texts: list[bytes], limit: int = GROUP_BYTES) -> Iterator[tuple[int, int]]:
    """Stretches [i, j) of neighbouring texts with about ``limit`` bytes; a longer text is a stretch of its own."""
    start, held = 0, 0
    for i, text in enumerate(texts):
        if i > start and held + len(text) > limit:
            yield start, i
            start, held = i, 0
        held += len(text) + 1
    if start < len(texts):
        yield start, len(texts)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose output bits all depend on all input bits."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BASE = 0x9E3779B97F4A7C15
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True


@lru_cache(maxsize=1)
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(size, _BASE, np.uint64), np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes and start offsets of the words between ASCII white space."""
    hashes, starts = [], []
    at = 0
    while at < len(data):
        end = len(data)
        if end - at > 2 * GROUP_BYTES:  # cut between words, so that the tables of powers stay small
            cuts = [c for c in (data.find(s, at + GROUP_BYTES) for s in (b" ", b"\n", b"\t")) if c >= 0]
            end = min(cuts, default=end)
        a = np.frombuffer(data, np.uint8, end - at, at)
        inside = ~_IS_SPACE[a]
        edges = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).astype(np.int8)))
        s, e = edges[0::2], edges[1::2]
        up, down = _powers(max(4 * GROUP_BYTES, 1 << (end - at + 1).bit_length()))
        sums = np.zeros(len(a) + 1, np.uint64)
        np.cumsum((a.astype(np.uint64) + np.uint64(1)) * up[: len(a)], out=sums[1:])
        hashes.append(mix((sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64)))
        starts.append(s + at)
        at = end
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(starts)


def words_by_text(texts: list[bytes]) -> Iterator[tuple[int, np.ndarray]]:
    """(index, hashes of its words in order) of each text, in order."""
    for i, j in groups(texts):
        hashes, starts = word_hashes(b"\n".join(texts[i:j]))
        begins = np.cumsum([0, *(len(t) + 1 for t in texts[i:j])])
        cuts = np.searchsorted(starts, begins)
        for k in range(i, j):
            yield k, hashes[cuts[k - i] : cuts[k - i + 1]]


@lru_cache(maxsize=4)
def rank_file(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


@lru_cache(maxsize=4)
def byte_bpe(path: str):
    """A tiktoken encoder of a rank file, without special tokens."""
    import public_tokenizers
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=rank_file(path), special_tokens={})


def vocabulary(name: str) -> str:
    """Where a public vocabulary lies on the machine that asks."""
    import public_tokenizers

    return public_tokenizers.path(name)


def maybe_in(rows: DataFrame, column: str, members: DataFrame, bits: int = 25) -> DataFrame:
    """The rows whose ``column`` may be in ``members``, a table with that one column; none that is goes missing.

    A bitmap of 2^bits bits, whatever the number of members, is sent to the executors. It only spares the shuffle of a following join
    rows that cannot match; with very many members it lets more rows through.
    """
    bit = F.shiftrightunsigned(F.xxhash64(F.lit(1), column), 64 - bits)
    one = F.call_function("shiftleft", F.lit(1).cast("long"), bit.bitwiseAND(63).cast("int"))
    found = members.select(F.shiftright(bit, 6).cast("int").alias("word"), one.alias("spot")).groupBy("word").agg(F.bit_or("spot").alias("spots")).toPandas()
    bitmap = np.zeros(1 << (bits - 6), np.int64)
    bitmap[found["word"].to_numpy(np.int64)] = found["spots"].to_numpy(np.int64)
    shared = rows.sparkSession.sparkContext.broadcast(bitmap.view(np.uint64))

    def maybe(spots: pa.Array) -> pa.Array:
        at = spots.to_numpy(zero_copy_only=False).astype(np.uint64)
        hit = (shared.value[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)
        return pa.array(hit.astype(bool))

    return rows.where(F.arrow_udf(maybe, "boolean")(bit))
