"""Nested records to flat columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def flat_columns(schema: StructType, separator: str = "_", parents: tuple[str, ...] = ()) -> list[Column]:
    """One aliased column per leaf; names of nested fields are joined by ``separator``."""
    columns: list[Column] = []
    for field in schema.fields:
        path = (*parents, field.name)
        if isinstance(field.dataType, StructType):
            columns += flat_columns(field.dataType, separator, path)
        else:
            quoted = ".".join(f"`{part}`" for part in path)
            columns.append(F.col(quoted).alias(separator.join(path)))
    return columns


def flatten(df: DataFrame, separator: str = "_") -> DataFrame:
    return df.select(*flat_columns(df.schema, separator))
