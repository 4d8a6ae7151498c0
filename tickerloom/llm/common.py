"""Helpers of the text operators: words, word hashes, shingles, Arrow columns."""

from __future__ import annotations

import pickle
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


BATCH_ROWS, _ARROW_ROWS = "1000", "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of texts of 1,000 rows, where the session has Spark's default of 10,000: executor and Python worker
    each hold whole batches, and give back little of the memory that the largest one took."""
    if spark.conf.get(_ARROW_ROWS) == "10000":
        spark.conf.set(_ARROW_ROWS, BATCH_ROWS)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def utf8(text: Column) -> Column:
    """The bytes of a text; null counts as empty."""
    return F.coalesce(text, F.lit("")).cast("binary")


def held_out(doc_id: Column, modulus: int, remainder: int) -> Column:
    """Fold of a document from the CRC-32 of its id as text; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == remainder, F.lit(False))


def share(spark: SparkSession, value) -> Callable[[], object]:
    """A broadcast of any object of this package: a function for tasks that gives it back.

    The object travels with the definition of its class, as functions do, so executors need no copy of the package.
    """
    data = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    return lambda: pickle.loads(data.value)


def unused(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column of ``df`` has it."""
    taken = {column.lower() for column in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


# Keys of 8 bytes up to this number are broadcast; more are left to a shuffled join.
BROADCAST_ROWS = 1_000_000


def among(rows: DataFrame, key: str, keys: DataFrame, there: bool) -> DataFrame:
    """Rows whose ``key`` (never null) is in the pinned one-column table ``keys``, or is not."""
    side = F.broadcast(keys) if keys.count() <= BROADCAST_ROWS else keys
    return rows.join(side, key, "left_semi" if there else "left_anti")


class WordHashes(dict):
    """64-bit hashes of words (bytes), remembered up to a bound of entries."""

    LIMIT = 100_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(values: np.ndarray) -> np.ndarray:
    """Finalising mix of 64-bit values (all bits of the input reach all bits of the output)."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the runs of ``size`` words, in order; a shorter non-empty sequence is one shingle."""
    if not len(words):
        return words
    width = min(size, len(words))
    total = np.full(len(words) - width + 1, width, np.uint64)
    for i in range(width):
        total = mixed(total + words[i:len(words) - width + 1 + i] + np.uint64(0x9E3779B97F4A7C15))
    return total


def signed(values: np.ndarray) -> pa.Array:
    """64-bit patterns as a column of Spark longs."""
    return pa.array(np.ascontiguousarray(values, np.uint64).view(np.int64))


def lists(lengths: np.ndarray, values: pa.Array) -> pa.Array:
    """Array column from the lengths of the rows and all values in a row."""
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


def list_slices(batches, column: str, most_values: int = 500_000):
    """Arrow batches cut so that the lists of a piece hold about ``most_values`` values (one row at least)."""
    for batch in batches:
        ends = np.cumsum(np.diff(np.asarray(batch.column(column).offsets)))
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + most_values, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def slices(batches, most_bytes: int = 2 << 20, *columns: str):
    """Arrow batches cut so that a piece holds about ``most_bytes`` of the texts in ``columns`` together (one row at least).

    What a piece has left in Arrow's pool is given back before the next one, as workers live on from stage to stage.
    """
    for batch in batches:
        lengths = [pa.compute.fill_null(pa.compute.binary_length(batch.column(name)), 0) for name in columns or ("text",)]
        ends = np.cumsum(np.sum([np.asarray(length, np.int64) for length in lengths], axis=0))
        start = 0
        while start < batch.num_rows:
            base = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, base + most_bytes, "right")))
            yield batch.slice(start, stop - start)
            pa.default_memory_pool().release_unused()
            start = stop
