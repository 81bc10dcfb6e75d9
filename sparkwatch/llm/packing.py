"""Token ids packed into rows of equal length by best-fit decreasing.

Documents become token ids with an end token and are split into pieces of at most a row's length, so nothing is lost. Pieces are
dealt to shards of bounded size; in a shard the longest piece goes first, each into the open row with the least room that
is enough. A segment tree over the possible amounts of room finds that row. A packed row has its ids, padded to the
full length, the cumulative lengths of its segments, and positions that start again with each segment.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sparkwatch.llm.bpe import VOCABULARY, codec
from sparkwatch.llm.common import texts_of


@dataclass(frozen=True)
class Packing:
    """``length`` tokens a row. ``end`` follows each document and also pads; ids are stored in two bytes."""

    length: int = 2048
    end: int = 50256
    shard_documents: int = 2048
    name: str = VOCABULARY
    seed: int = 23

    #: Little-endian unsigned 16-bit integers.
    id_type = "<u2"


class Room:
    """Open rows by the room they have left; a segment tree over the amounts of room tells the least one that is enough."""

    def __init__(self, length: int):
        self.leaves = 1 << (length + 1).bit_length()
        self.tree = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(length + 1)]

    def _add(self, room: int, change: int) -> None:
        at = room + self.leaves
        while at:
            self.tree[at] += change
            at >>= 1

    def open(self, row: int, room: int) -> None:
        self.rows[room].append(row)
        self._add(room, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """(row, its room) of the open row with the least room of at least ``need``; of equals the one opened last."""
        at = need + self.leaves
        if not self.tree[at]:
            while at > 1 and (at & 1 or not self.tree[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.leaves:
                at = 2 * at if self.tree[2 * at] else 2 * at + 1
        room = at - self.leaves
        self._add(room, -1)
        return self.rows[room].pop(), room


def best_fit_decreasing(sizes: list[int], length: int) -> list[list[int]]:
    """Rows of positions in ``sizes``; longest first, equal ones in the order given."""
    room, rows = Room(length), []
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        found = room.take(sizes[i])
        if found is None:
            rows.append([i])
            room.open(len(rows) - 1, length - sizes[i])
        else:
            rows[found[0]].append(i)
            room.open(found[0], found[1] - sizes[i])
    return rows


def pieces(df: DataFrame, doc_id: str = "doc_id", text: str = "text", spec: Packing = Packing()) -> DataFrame:
    """``doc_id, piece, n_pieces, n, ids`` of each document: its ids and the end token, split at every ``length``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to = codec(spec.name)
        width = np.dtype(spec.id_type).itemsize
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for at, x in zip(batch.column("doc_id").to_pylist(), texts_of(batch.column("text"))):
                data = np.array([*to.encode(x), spec.end], spec.id_type).tobytes()
                cuts = range(0, len(data), spec.length * width)
                for k, cut in enumerate(cuts):
                    part = data[cut : cut + spec.length * width]
                    for column, value in zip(out, (at, k, len(cuts), len(part) // width, part)):
                        column.append(value)
            kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds)], ["doc_id", "piece", "n_pieces", "n", "ids"])

    rows = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, piece int, n_pieces int, n int, ids binary")


_PACKED = (
    "shard long, row int, n_tokens int, ids binary, positions binary, lengths array<int>, "
    "doc_ids array<long>, pieces array<int>, n_pieces array<int>"
)


def pack(df: DataFrame, doc_id: str = "doc_id", text: str = "text", spec: Packing = Packing()) -> DataFrame:
    """One row per packed sequence: ``shard, row, n_tokens``, ``ids`` and ``positions`` (``length`` two-byte integers each),
    ``lengths`` (cumulative, from 0), and the document, piece number and number of pieces of each segment.

    A missing or empty text is the end token alone. Documents keep missing and repeated ids, each is packed on its own. An empty table has
    no rows. Padding repeats the end token at position 0 and belongs to no segment. Other columns are not read.

    Shards have about ``shard_documents`` documents; pieces are dealt by hashes of id, number and length, so a giant document is spread.
    """
    shards = max(1, -(-df.count() // spec.shard_documents))
    dealt = pieces(df, doc_id, text, spec)
    spread = F.xxhash64(F.lit(spec.seed), "doc_id", "piece", "n", F.when(F.col("doc_id").isNull(), F.crc32("ids")))
    dealt = dealt.withColumn("shard", F.pmod(spread, F.lit(shards)))

    def packed(table: pa.Table) -> pa.Table:
        table = table.sort_by([("n", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids", "ascending")])
        sizes = table.column("n").to_pylist()
        ids = table.column("ids").to_pylist()
        width = np.dtype(spec.id_type).itemsize
        pad = np.full(spec.length, spec.end, spec.id_type).tobytes()
        count = np.arange(spec.length).astype(spec.id_type).tobytes()
        rows = best_fit_decreasing(sizes, spec.length)
        used = [sum(sizes[i] for i in row) for row in rows]
        own = {c: table.column(c).to_pylist() for c in ("doc_id", "piece", "n_pieces")}
        filled = [b"".join(ids[i] for i in row) for row in rows]
        places = [b"".join(count[: sizes[i] * width] for i in row) for row in rows]
        columns = {
            "shard": pa.array([table.column("shard")[0].as_py()] * len(rows), pa.int64()),
            "row": pa.array(range(len(rows)), pa.int32()),
            "n_tokens": pa.array(used, pa.int32()),
            "ids": pa.array([x + pad[len(x) :] for x in filled], pa.binary()),
            "positions": pa.array([x + bytes(spec.length * width - len(x)) for x in places], pa.binary()),
            "lengths": pa.array([np.cumsum([0, *(sizes[i] for i in row)]).tolist() for row in rows], pa.list_(pa.int32())),
            "doc_ids": pa.array([[own["doc_id"][i] for i in row] for row in rows], pa.list_(pa.int64())),
            "pieces": pa.array([[own["piece"][i] for i in row] for row in rows], pa.list_(pa.int32())),
            "n_pieces": pa.array([[own["n_pieces"][i] for i in row] for row in rows], pa.list_(pa.int32())),
        }
        return pa.table(columns)

    return dealt.groupBy("shard").applyInArrow(packed, _PACKED)


def unpack(packed: DataFrame, spec: Packing = Packing()) -> DataFrame:
    """``doc_id, piece, n_pieces, ids`` of all segments, as they were before packing."""
    width = np.dtype(spec.id_type).itemsize
    each = packed.select("ids", "lengths", F.posexplode(F.arrays_zip("doc_ids", "pieces", "n_pieces")).alias("at", "s"))
    begin, end = F.get("lengths", F.col("at")), F.get("lengths", F.col("at") + 1)
    part = F.substr("ids", begin * width + 1, (end - begin) * width)
    return each.select(F.col("s.doc_ids").alias("doc_id"), F.col("s.pieces").alias("piece"), F.col("s.n_pieces").alias("n_pieces"), part.alias("ids"))


def write(packed: DataFrame, path: str) -> None:
    """Parquet files of packed rows; a shard's rows stay together."""
    packed.write.mode("errorifexists").parquet(path)
