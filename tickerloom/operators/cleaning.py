"""Row cleaning, renaming, label coding and validation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickerloom.session import pin

# Fixed value: names of the panel columns in exported files.
PANEL_NAMES = {
    "index": "Index",
    "permco": "Permco",
    "ticker": "Ticker",
    "start_date": "Start_Date",
    "end_date": "End_Date",
    "weekly_ret": "Weekly_Return",
    "adj_prc": "Adjusted_Price",
    "headline": "Headline",
    "direction": "Direction",
}
PANEL_COLUMNS = ["permco", "ticker", "start_date", "end_date", "weekly_ret", "adj_prc", "headline", "direction"]


class MissingValues(ValueError):
    """Raised by ``require_complete`` and ``write_complete``."""


def drop_incomplete(df: DataFrame, subset: Sequence[str] | None = None) -> DataFrame:
    """Without the rows that miss any value (of ``subset``)."""
    return df.na.drop("any", subset=list(subset) if subset else None)


def rename(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    """Rename columns; names that the frame lacks are ignored."""
    return df.withColumnsRenamed(dict(names))


def label_code(column: Column) -> Column:
    """'Up' to 1, 'Down' to 0, anything else to null."""
    return F.when(column == "Up", 1).when(column == "Down", 0)


def _missing(df: DataFrame, name: str) -> Column:
    """Null, or NaN in a column of floating point."""
    fractional = isinstance(df.schema[name].dataType, T.FractionalType) and not isinstance(df.schema[name].dataType, T.DecimalType)
    return F.col(name).isNull() | F.isnan(name) if fractional else F.col(name).isNull()


def null_counts(df: DataFrame) -> DataFrame:
    """(column_name, n_null): one aggregate over the frame, then one row per column; NaN counts as missing."""
    wide = df.agg(*[F.count_if(_missing(df, name)).alias(name) for name in df.columns])
    return wide.unpivot([], list(df.columns), "column_name", "n_null")


def require_complete(df: DataFrame) -> DataFrame:
    """The frame itself, after an action that fails if any value is missing."""
    missing = null_counts(df).where("n_null > 0").take(len(df.columns))
    if missing:
        raise MissingValues(", ".join(f"{row.column_name}: {row.n_null}" for row in missing))
    return df


_MISSING_MARK = "missing value in column"


def write_complete(df: DataFrame, label: str = "complete") -> DataFrame:
    """The frame, written once; the run itself fails on a missing value, with an error that counts them by column.

    Every row is checked while it is written, so a complete frame is evaluated once; only a failure is counted by a second
    pass.  (Observed metrics would count in the same run, but they leave an object in the session that later ML closures
    cannot be shipped with.)
    """
    checks = [F.when(_missing(df, name), F.raise_error(F.lit(f"{_MISSING_MARK} {name}")).cast("boolean")) for name in df.columns]
    try:
        return pin(df.where(F.coalesce(*checks, F.lit(True))), label)
    except Exception as error:
        if _MISSING_MARK not in str(error):
            raise
        counts = null_counts(df).where("n_null > 0").take(len(df.columns))
        by_name = {row.column_name: row.n_null for row in counts}
        raise MissingValues(", ".join(f"{name}: {by_name[name]}" for name in df.columns if name in by_name)) from None


def schema_profile(df: DataFrame) -> DataFrame:
    """(column_name, data_type, non_null) per column."""
    kinds = dict(df.dtypes)
    wide = df.agg(*[F.count_if(~_missing(df, name)).alias(name) for name in df.columns])
    by_name = F.create_map(*[F.lit(part) for name in df.columns for part in (name, kinds[name])])
    return (
        wide.unpivot([], list(df.columns), "column_name", "non_null")
        .withColumn("data_type", by_name[F.col("column_name")])
    )


def numeric_columns(df: DataFrame) -> list[str]:
    return [field.name for field in df.schema.fields if isinstance(field.dataType, T.NumericType)]


def clean_panel(panel: DataFrame, extra_columns: Sequence[str] = ()) -> DataFrame:
    """Panel rows for export: fixed columns, exact duplicates removed, exported names, coded direction."""
    rows = rename(panel.select(*extra_columns, *PANEL_COLUMNS).dropDuplicates(), PANEL_NAMES)
    return rows.withColumn("Direction", label_code(F.col("Direction")))


def union_by_name(frames: Sequence[DataFrame]) -> DataFrame:
    """All rows of all frames; a column that a frame lacks is null there."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
