"""A corpus pipeline: quality, line dedup, near duplicates, source mix, token ids.

Each stage takes ``(spark, docs, sf_dir)`` and works on all rows it gets; all but the last return the columns of ``docs``.
Extra columns go along. Rows without an id pass the stages that compare documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sparkwatch.llm import bpe, mixing, ngram_join, quality, templates
from sparkwatch.llm.common import WORD, documents, free_name, labels
from sparkwatch.session import stored


def _recounted(docs: DataFrame) -> DataFrame:
    """``n_chars`` of the text as it is now, where there is such a column."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the attention model does not reject."""
    return quality.keep_good(docs, labels(spark, sf_dir))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines of recurring templates. A document goes if only words of such lines stood in it."""
    dropped = free_name(docs, "n_dropped")
    done = templates.drop_templates(docs, n_dropped=dropped)
    left = (F.col(dropped) == 0) | F.col("text").rlike(WORD)
    return _recounted(done.where(left).drop(dropped))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id; one row per id."""
    groups = ngram_join.near_duplicates(docs)
    first = groups.where(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()
    kept = docs.join(first, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return kept.unionByName(docs.where(F.col("doc_id").isNull())).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts as the mix takes them: whole, in part or repeated; documents of which nothing is taken go."""
    return _recounted(mixing.apply_mix(docs, mixing.mix(docs)))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, and whether they decode to it."""
    ids, decoded = free_name(docs, "ids"), free_name(docs, "decoded")
    done = bpe.decode(bpe.encode(docs, out=ids), ids=ids, out=decoded)
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    return done.select(
        "doc_id",
        "lang",
        "source",
        (F.octet_length(ids) / 4).cast("long").alias("n_tokens"),
        (F.col(decoded) == text).alias("round_trip"),
        F.sha2(ids, 256).alias("ids_sha256"),
        F.col(ids).alias("ids"),
    )


STAGES = [
    ("quality", keep_quality),
    ("line_dedup", drop_lines),
    ("near_duplicates", one_of_each_group),
    ("source_mix", mix_sources),
    ("byte_bpe", encode),
]

# Learned weights, hashes and a tokeniser decide here, none of which SQL has.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stored(docs)
    return docs
