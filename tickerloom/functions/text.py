"""Text expressions: tokens, hashed buckets, vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# Fixed value: a token is a run of two or more letters, digits or underscores.
TOKEN_PATTERN = r"[\p{L}\p{N}_]{2,}"


def tokens(text: Column) -> Column:
    """Lower-case word tokens in text order."""
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN_PATTERN), F.lit(0))


def english_stop_words(spark: SparkSession) -> list[str]:
    """Spark ML's public English list (a few hundred words at most)."""
    return StopWordsRemover.loadDefaultStopWords("english")


def bigrams(words: Column) -> Column:
    """Adjacent word pairs joined by a space."""
    pairs = F.zip_with(
        F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))),
        F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))),
        lambda a, b: F.concat_ws(" ", a, b),
    )
    return F.when(F.size(words) >= 2, pairs).otherwise(F.array().cast("array<string>"))


def bucket_of(term: Column, width: int) -> Column:
    """Hash bucket 0..width-1: the first 32 bits of md5, modulo ``width``."""
    return (hash_of(term) % width).cast("int")


def hash_of(term: Column) -> Column:
    """The first 32 bits of the md5 as a number; its remainder is the bucket."""
    return F.conv(F.substring(F.md5(term), 1, 8), 16, 10).cast("bigint")


def hashed_vector(terms: Column, width: int) -> Column:
    """Mean one-hot vector of the hashed terms, inside the row; see ``mean_one_hot``."""
    return mean_one_hot(F.transform(terms, hash_of), width)


def mean_one_hot(hashes: Column, width: int) -> Column:
    """Mean one-hot vector of hashes of terms.

    Costs one count per term and needs no shuffle, so it suits short texts; long texts go through
    ``operators.vectors.hashed_long``.  Null terms give a vector of nulls.
    """

    @F.arrow_udf("array<double>")
    def shares(rows: pa.Array) -> pa.Array:
        there = np.asarray(pc.is_valid(rows))
        sizes = pc.fill_null(pc.list_value_length(rows), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        buckets = rows.flatten().to_numpy(zero_copy_only=False) % width
        cells = np.bincount(np.repeat(np.arange(len(rows)) * width, sizes) + buckets, minlength=len(rows) * width)
        values = pa.array(cells / np.repeat(np.maximum(sizes, 1), width), mask=np.repeat(~there, width))
        return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * width, pa.int32()), values)

    return shares(hashes)


def parse_vector(text: Column) -> Column:
    """List text such as ``[0.1, 0.2]`` to an array of doubles."""
    return F.from_json(text, "array<double>")
