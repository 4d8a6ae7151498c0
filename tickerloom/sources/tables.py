"""Tables by name: parquet folders as views, SQL over them, JDBC where a database exists."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def register_views(frames: Mapping[str, DataFrame]) -> None:
    """Make frames visible to SQL under their names."""
    for name, frame in frames.items():
        frame.createOrReplaceTempView(name)


def run_sql(spark: SparkSession, text: str, args: Mapping[str, Any] | None = None) -> DataFrame:
    """SQL text with named parameters (``:name``); values are bound, never pasted into the text."""
    return spark.sql(text, args=dict(args or {}))


def read_jdbc(spark: SparkSession, url: str, table: str, key: str, lower: int, upper: int, parts: int) -> DataFrame:
    """Partitioned read of a database table; the database driver must be on the class path."""
    return spark.read.jdbc(
        url, table, column=key, lowerBound=lower, upperBound=upper, numPartitions=parts
    )


def list_tables(spark: SparkSession, database: str | None = None) -> DataFrame:
    """Names of the tables and views of a database."""
    names = [(table.name, table.isTemporary) for table in spark.catalog.listTables(database)]
    return spark.createDataFrame(names, "table_name string, is_temporary boolean")


def with_row_counts(spark: SparkSession, listed: DataFrame, names: list[str]) -> DataFrame:
    """The listed tables among ``names`` with their row counts: one aggregate over all of them."""
    rows = [spark.table(name).select(F.lit(name).alias("table_name")) for name in names]
    counts = reduce(DataFrame.unionByName, rows).groupBy("table_name").agg(F.count("*").alias("n_rows"))
    chosen = listed.where(F.col("table_name").isin(names)).select("table_name")
    return chosen.join(counts, "table_name", "left").na.fill(0, ["n_rows"])
