"""A left join that adaptive execution can split on both sides."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def left_join_split(left: DataFrame, right: DataFrame, on: Sequence[str], null_safe: bool = False) -> DataFrame:
    """Left join on columns of the same name; unmatched rows get nulls.  ``null_safe``: null keys match.

    Adaptive execution may split a key with very many rows on either side of an inner join, but not on the
    right side of a left join.  So this is the inner join, plus the left rows whose key the right side
    lacks; that anti join sees one row per key of the right side.  Both joins shuffle the left side in the
    same way, so that exchange is shared; the right side is read again for its keys, so a caller whose right
    side is dear passes a pinned table.
    """
    renamed = right.withColumnsRenamed({name: f"_{name}" for name in on})

    def same(other: DataFrame) -> list[Column]:
        pairs = [(left[name], other[f"_{name}"]) for name in on]
        return [a.eqNullSafe(b) if null_safe else a == b for a, b in pairs]

    matched = left.join(renamed, same(renamed), "inner").drop(*[f"_{name}" for name in on])
    keys = renamed.select(*[f"_{name}" for name in on]).distinct()
    alone = left.join(keys, same(keys), "left_anti")
    missing = [F.lit(None).cast(right.schema[name].dataType).alias(name) for name in right.columns if name not in on]
    return matched.unionByName(alone.select("*", *missing))
