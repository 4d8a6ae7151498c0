"""Split grouped work by group size: small groups go to one task each, large ones are spread."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Feature values (rows x width) that one task may hold for a group: 32 MB of doubles.
MAX_GROUP_VALUES = 4_000_000


class BySize(NamedTuple):
    small: DataFrame
    large: DataFrame | None
    large_sizes: DataFrame | None


class Compact(NamedTuple):
    """Rows whose feature vectors, many times as large, are made where they are used and never shuffled.

    ``widen`` adds the rest of the keys and the features, row by row; ``by`` are the keys that ``rows`` have already, ``width``
    is the length of the longest vector.
    """

    rows: DataFrame
    by: list[str]
    widen: Callable[[DataFrame], DataFrame]
    width: int

    def wide(self) -> DataFrame:
        return self.widen(self.rows)

    def together(self) -> DataFrame:
        """The wide rows, those of a group of ``by`` in one partition and one after the other, in the order of ``mark_of(by)``."""
        return self.widen(self.rows.repartition(*self.by).sortWithinPartitions(mark_of(self.by)))


def mark_of(keys: Sequence[str]) -> Column:
    """A hash that stands for the group; two groups may share it."""
    return F.xxhash64(*keys)


def group_numbers(keys: list[pa.Array]) -> tuple[np.ndarray, np.ndarray]:
    """First row of each group, and the number of the group of each row."""
    number, first = np.zeros(len(keys[0]), np.int64), np.zeros(1, np.int64)
    for key in keys:
        codes = key.dictionary_encode(null_encoding="encode")
        _, first, number = np.unique(number * len(codes.dictionary) + codes.indices.to_numpy(), return_index=True, return_inverse=True)
    return first, number


def widest(rows: DataFrame, features: str) -> int:
    """Length of the longest feature array (groups may differ); 1 at least."""
    return max(1, rows.agg(F.max(F.size(features)).alias("width")).first().width or 1)


def split_by_size(rows: DataFrame, keys: Sequence[str], max_rows: int) -> BySize:
    """Rows of groups up to ``max_rows`` rows, and rows and sizes of the groups above, if there are any.

    ``rows`` is read twice, so it should be a table or pinned.  The count reads the keys only.
    """
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("group_rows")).where(F.col("group_rows") > max_rows)
    if sizes.isEmpty():
        return BySize(rows, None, None)
    on = list(keys)
    return BySize(rows.join(sizes, on, "left_anti"), rows.join(sizes, on, "left_semi"), sizes)
