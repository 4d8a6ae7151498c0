"""CSV with fixed schemas."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_RECORD = "_bad_record"


def write_csv(df: DataFrame, path: str, order: Sequence[str] = ()) -> None:
    """Header, no index, sorted by ``order`` across the files.  Quotes inside text are doubled."""
    rows = df.orderBy(*order) if order else df
    rows.write.option("header", True).option("escape", '"').option("emptyValue", '""').csv(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType, multi_line: bool = False) -> DataFrame:
    """Strict read: a value that does not fit its type, or a row of the wrong width, is an error.

    ``multi_line`` is for text with line breaks inside; such files cannot be split between tasks.
    """
    return (
        spark.read.schema(schema).option("header", True).option("escape", '"').option("mode", "FAILFAST")
        .option("multiLine", multi_line).csv(path)
    )


def read_csv_skipping_wide_rows(
    spark: SparkSession, path: str, schema: T.StructType, header: bool = True, multi_line: bool = False
) -> DataFrame:
    """Tolerant read: rows with too many fields are left out, short rows are filled with nulls.

    A record that does not fit the schema is kept as text beside its fields, where its separators outside quotes are
    counted (a doubled quote is the end of one quoted piece and the start of the next); empty surplus fields count too.  DROPMALFORMED would lose the short rows as well.
    """
    fields = T.StructType([*schema.fields, T.StructField(_RECORD, T.StringType(), True)])
    rows = (
        spark.read.schema(fields).option("header", header).option("enforceSchema", True).option("escape", '"')
        .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", _RECORD).option("columnPruning", False)
        .option("multiLine", multi_line).csv(path)
    )
    separators = F.length(F.regexp_replace(F.regexp_replace(_RECORD, r'"[^"]*"', ""), "[^,]", ""))
    return rows.where(F.coalesce(separators < len(schema.fields), F.lit(True))).drop(_RECORD)
