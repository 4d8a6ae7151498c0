"""From raw documents to token ids: five stages, each on all that the one before it kept.

Every stage but the last returns the columns of ``documents``.  Rows are told apart by doc_id and text together, so
null and repeated doc_ids are kept apart where their texts differ.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickerloom.llm import bytepair, common, decontaminate, jaccard, outliers, personal
from tickerloom.session import pin

SHINGLE_WORDS, SIMILAR_PERCENT = 5, 80
VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and are no outliers of their language and source.

    Null and empty texts fail the base rules; null languages and sources are groups of their own; rows equal in all four
    columns are judged alike and all stay or go; an empty table stays empty.
    """
    common.small_batches(spark)
    return outliers.kept(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates (five words, similarity of 0.8).

    Texts without words are near nothing and stay, repeated ones too; of repeated rows one stays; a null id comes after all
    others; an empty table stays empty.
    """
    common.small_batches(spark)
    return jaccard.representatives(docs, SHINGLE_WORDS, SIMILAR_PERCENT)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark.

    Null and empty texts hold none and stay; null and empty items match nothing; repeated rows share their fate; without
    documents or without items nothing changes.
    """
    common.small_batches(spark)
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind.

    Null and empty texts stay as they are; repeated rows are redacted alike; an empty table stays empty.
    """
    common.small_batches(spark)
    return personal.redacted(docs, personal.train(docs))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, n_tokens, ids): ids as little-endian unsigned 32-bit integers.

    Null and empty texts have no ids; every row is encoded, repeated ones too; an empty table gives no rows.
    """
    common.small_batches(spark)
    return bytepair.encode_decode(docs, public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN).select("doc_id", "n_tokens", "ids")


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontaminated", decontaminated),
    ("without_personal_data", without_personal_data),
    ("encoded", encoded),
]

# The robust fits, edit distances and merges have no SQL form; tests compare with plain versions instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = pin(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
