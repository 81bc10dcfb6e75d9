"""The registered queries of the text operators over the given tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sparkwatch.llm import bpe, fertility, language, lm_difference, merkle, mixing, ngram_join, ordermin, packing, quality, sharding, templates, whitening
from sparkwatch.llm.common import documents, labels


def tokeniser_fertility(spark: SparkSession, sf: str) -> DataFrame:
    return fertility.report(documents(spark, sf))


def lm_cross_entropy_difference(spark: SparkSession, sf: str) -> DataFrame:
    """The target is what is labelled good and not toxic."""
    good = labels(spark, sf).where("quality = 1 AND toxic = 0").select("doc_id")
    return lm_difference.score(documents(spark, sf), good)


def source_mix(spark: SparkSession, sf: str) -> DataFrame:
    columns = ["doc_id", "size", "source_size", "target", "taken", "source", "weight", "rounds"]
    return mixing.mix(documents(spark, sf)).select(*columns)


def ngram_jaccard_join(spark: SparkSession, sf: str) -> DataFrame:
    return ngram_join.near_duplicates(documents(spark, sf))


def language_by_compression(spark: SparkSession, sf: str) -> DataFrame:
    return language.report(documents(spark, sf))


def line_templates(spark: SparkSession, sf: str) -> DataFrame:
    return templates.report(documents(spark, sf))


def byte_bpe(spark: SparkSession, sf: str) -> DataFrame:
    return bpe.digests(documents(spark, sf))


def packed_token_ids(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack(documents(spark, sf))


def order_minhash(spark: SparkSession, sf: str) -> DataFrame:
    return ordermin.edited_report(documents(spark, sf))


def attention_quality(spark: SparkSession, sf: str) -> DataFrame:
    return quality.report(documents(spark, sf), labels(spark, sf))


def external_shuffle(spark: SparkSession, sf: str) -> DataFrame:
    return sharding.report(documents(spark, sf))


def merkle_manifest(spark: SparkSession, sf: str) -> DataFrame:
    return merkle.report(documents(spark, sf))


def embedding_whitening(spark: SparkSession, sf: str) -> DataFrame:
    return whitening.report(spark.read.parquet(f"{sf}/embeddings.parquet"))


QUERIES = {
    "op1_tokeniser_fertility": tokeniser_fertility,
    "op2_lm_cross_entropy_difference": lm_cross_entropy_difference,
    "op3_source_mix": source_mix,
    "op4_ngram_jaccard_join": ngram_jaccard_join,
    "op5_language_by_compression": language_by_compression,
    "op6_line_templates": line_templates,
    "op7_byte_bpe": byte_bpe,
    "op8_packed_token_ids": packed_token_ids,
    "op9_order_minhash": order_minhash,
    "op10_attention_quality": attention_quality,
    "op11_external_shuffle": external_shuffle,
    "op12_merkle_manifest": merkle_manifest,
    "op13_embedding_whitening": embedding_whitening,
}

ORACLES: dict[str, str] = {"op12_merkle_manifest": merkle.ORACLE}
