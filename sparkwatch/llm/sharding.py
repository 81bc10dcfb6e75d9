"""Two-pass external shuffle of a table into shards, with DataFrame functions only.

1. Every row goes to one of many buckets by a seeded hash of where it stands (file and row number), so neither equal texts, nor a
   frequent id, nor missing ids make a bucket larger than others. There are as many buckets as it takes for one to fit in the
   memory of a task, and a task holds exactly one.
2. Each bucket is put in a fixed order, shuffled by Fisher-Yates (Spark's ``shuffle``) and written to the shared folder.

The shuffled buckets one behind the other are a random order of all rows. The shards are that order cut into stretches whose row
counts differ by one at most (the law is ``rows``), and a row's slot is its place in its stretch.

Nulls, empty texts and repeated rows are rows like others; a text of any length travels whole. An empty table gives an empty one.
Extra columns go along; ``shard`` and ``slot`` get underscores in front where a column has that name.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window, functions as F

from sparkwatch.llm.common import free_name
from sparkwatch.session import discard, stored

#: More buckets are not made: where each begins is sent to all tasks, 16 bytes a bucket. Above 32 TB they grow instead.
MOST_BUCKETS = 1 << 20
_BLOCK = 4096


@dataclass(frozen=True)
class ShuffleConfig:
    shards: int = 24
    seed: int = 20_240_611
    #: What a task holds of texts at once. Spark needs about five times that while it shuffles the bucket.
    bucket_bytes: int = 32 << 20


def size_of(text: Column) -> Column:
    """UTF-8 bytes of a text (none if it is missing) and 8 for the row."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long")


def shuffled(docs: DataFrame, config: ShuffleConfig = ShuffleConfig(), text: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` with ``shard`` and ``slot``, from the written buckets."""
    columns = docs.columns
    bucket, place, row, key = (free_name(docs, name) for name in ("_bucket", "_place", "_row", "_key"))
    rows, where = _numbered(docs, key)
    totals = rows.agg(F.count(F.lit(1)).alias("n"), F.sum(size_of(F.col(text))).alias("bytes")).first()
    n, buckets = totals["n"], min(MOST_BUCKETS, max(1, ceil((totals["bytes"] or 0) / config.bucket_bytes)))

    to = F.pmod(F.xxhash64(F.lit(config.seed), F.col(key)), F.lit(buckets)).cast("int")
    packed = rows.select(to.alias(bucket), F.struct(F.col(key), F.struct(*[_named(c) for c in columns]).alias("row")).alias(row))
    dealt = packed.repartitionById(buckets, F.col(bucket)).groupBy(bucket).agg(F.collect_list(row).alias(row))
    ordered = F.array_sort(row, lambda a, b: F.when(a[key] < b[key], -1).when(a[key] > b[key], 1).otherwise(0))
    mixed = dealt.select(bucket, F.posexplode(F.shuffle(ordered, config.seed)).alias(place, row))
    written = stored(mixed.select(bucket, place, F.col(f"{row}.row.*")))
    if where is not None:
        discard(where)

    begin = free_name(docs, "_begin")
    begins = _begins(written.groupBy(bucket).agg(F.count(F.lit(1)).alias("_n")), bucket).withColumnRenamed("_begin", begin)
    at = F.col(begin) + F.col(place)
    shard, slot = free_name(docs, "shard"), free_name(docs, "slot")
    # whole-number division: a double would miss places beyond 2^53
    placed = written.join(F.broadcast(begins), bucket).withColumn(place, at)
    placed = placed.withColumn(shard, F.expr(f"cast(`{place}` * {config.shards} div {max(n, 1)} as int)"))
    first = F.expr(f"(cast(`{shard}` as bigint) * {n} + {config.shards - 1}) div {config.shards}")
    return placed.select(*[_named(c) for c in columns], shard, (F.col(place) - first).cast("long").alias(slot))


def write_shards(docs: DataFrame, path: str, shard: str = "shard", slot: str = "slot") -> None:
    """Write what ``shuffled`` returns, a folder per shard. Within a file rows stand in slot order; a bucket touches few shards, so there are few files."""
    docs.sortWithinPartitions(shard, slot).write.partitionBy(shard).parquet(path)


def _named(column: str) -> Column:
    return F.col("`" + column.replace("`", "``") + "`")


def _numbered(docs: DataFrame, key: str) -> tuple[DataFrame, DataFrame | None]:
    """Rows with a ``key`` of their own. That of a table in files is the file and the row in it; another frame is written first."""
    try:
        return docs.select("*", F.struct(F.col("_metadata.file_path"), F.col("_metadata.row_index")).alias(key)), None
    except AnalysisException:
        written = stored(docs)
        name = F.regexp_replace("_metadata.file_name", "-[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}", "")  # the same in each run
        return written.select("*", F.struct(name.alias("file_path"), F.col("_metadata.row_index")).alias(key)), written


def _begins(counts: DataFrame, bucket: str) -> DataFrame:
    """Rows in all earlier buckets, for each bucket: inside blocks of buckets, then over the blocks."""
    block = F.floor(F.col(bucket) / _BLOCK).alias("_block")
    inside = Window.partitionBy("_block").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(bucket, "_n", block).withColumn("_inside", F.coalesce(F.sum("_n").over(inside), F.lit(0)))
    blocks = counts.groupBy("_block").agg(F.sum("_n").alias("_m"))
    # at most MOST_BUCKETS / _BLOCK rows
    earlier = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("_block", F.coalesce(F.sum("_m").over(earlier), F.lit(0)).alias("_earlier"))
    return counts.join(blocks, "_block").select(bucket, (F.col("_earlier") + F.col("_inside")).alias("_begin"))


def report(docs: DataFrame, config: ShuffleConfig = ShuffleConfig()) -> DataFrame:
    """Per row: where it went, its size and the CRC of its text (0 if it has none)."""
    done = shuffled(docs.select("doc_id", "text"), config)
    return done.select(
        "doc_id",
        size_of(F.col("text")).alias("size"),
        F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
