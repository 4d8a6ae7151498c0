"""The registered queries of this folder: production parameters, whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickerloom.llm import (
    bytepair, classes, common, decontaminate, divergence, fingerprints, jaccard, language, oracles, outliers, personal, search, sentences,
    sharding, substrings,
)

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
SHARDS = 40


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.interleave(common.documents(spark, sf_dir), SHARDS)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "source")


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    return bytepair.digests(bytepair.encode_decode(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN))


def op3_quality_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = outliers.judged(common.documents(spark, sf_dir))
    return rows.select("doc_id", *outliers.STATISTICS, "base_failed", "kept")


def op4_class_ngrams(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    return classes.scores(docs.select("doc_id", "text", common.held_out(F.col("doc_id"), 7, 2).alias("held_out")))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = substrings.without_repeats(common.documents(spark, sf_dir).select("doc_id", "text"), window=400)
    return left.select(
        "doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op7_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = sentences.without_repeats(common.documents(spark, sf_dir).select("doc_id", "text"))
    return left.select(
        "doc_id", "n_sentences", "n_removed", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes_kept"),
        F.sha2(common.utf8(F.col("text")), 256).alias("kept_sha256"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.joined(common.documents(spark, sf_dir), size=3, percent=90).select("doc_id", "n_shingles", "component_id")


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    return personal.digests(personal.find(docs, personal.train(docs)))


def op10_language_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    fold = common.held_out(F.col("doc_id"), 4, 2)
    answers = language.identify(docs.select("doc_id", "text"), language.train(docs.where(~fold)))
    return answers.select("doc_id", fold.alias("held_out"), "lang_pred", "score")


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.report(common.documents(spark, sf_dir))


def op12_reversed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.ranked(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compared(common.documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": op1_sharding,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_quality_outliers": op3_quality_outliers,
    "op4_class_ngrams": op4_class_ngrams,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_decontamination": op6_decontamination,
    "op7_sentence_spans": op7_sentence_spans,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_personal_data": op9_personal_data,
    "op10_language_spans": op10_language_spans,
    "op11_divergence": op11_divergence,
    "op12_reversed_search": op12_reversed_search,
    "op13_merkle": op13_merkle,
}

ORACLES: dict[str, str] = oracles.ORACLES
