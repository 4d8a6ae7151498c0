"""Summary statistics, frequencies and histograms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickerloom.functions.numbers import nan_to_null
from tickerloom.operators.cleaning import numeric_columns
from tickerloom.operators.ordered import exact_quantiles
from tickerloom.params import HISTOGRAM_BINS, TOP_EVENT_TYPES


def summary_stats(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row per numeric column: n, mean, std (sample), min, q25, q50, q75, max; NaN counts as missing.

    Quartiles are exact with linear interpolation; they are taken from range-sorted value counts, so no
    task holds all values of a column.
    """
    names = list(columns or numeric_columns(df))
    long = df.select(*[nan_to_null(F.col(name).cast("double")).alias(name) for name in names]).unpivot([], names, "column_name", "value")
    basic = long.groupBy("column_name").agg(
        F.count("value").alias("n"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    quartiles = exact_quantiles(long, ["column_name"], "value", {"q25": 0.25, "q50": 0.5, "q75": 0.75})
    return basic.join(quartiles, "column_name", "left")


def top_categories(df: DataFrame, column: str, k: int = TOP_EVENT_TYPES) -> DataFrame:
    """The ``k`` most frequent values, missing ones left out; ties by name."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    return counts.orderBy(F.desc("n"), F.asc(column)).limit(k)


def histogram(df: DataFrame, column: str, bins: int = HISTOGRAM_BINS) -> DataFrame:
    """(bin, bin_low, bin_high, n): equal widths over [min, max], the last bin closed, empty bins kept.

    The bounds are scalar subqueries of one aggregate.
    """
    values = df.select(nan_to_null(F.col(column).cast("double")).alias("v")).where("v IS NOT NULL")
    bounds = values.agg(F.min("v").alias("low"), F.max("v").alias("high"))
    low, high = bounds.select("low").scalar(), bounds.select("high").scalar()
    place = F.when(high > low, F.least(F.width_bucket(F.col("v"), low, high, F.lit(bins)), F.lit(bins))).otherwise(1)
    counts = values.groupBy(place.cast("int").alias("bin")).agg(F.count("*").alias("n"))
    grid = df.sparkSession.range(1, bins + 1).select(F.col("id").cast("int").alias("bin"))
    width = (high - low) / bins
    return grid.join(counts, "bin", "left").select(
        "bin",
        (low + (F.col("bin") - 1) * width).alias("bin_low"),
        (low + F.col("bin") * width).alias("bin_high"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


# Rank error of a quantile from a sketch with this parameter: below 1.7 % of the rows with a confidence of 99 %.
SKETCH_SIZE = 200
SKETCH_RANK_ERROR = 0.017


def quantile_sketches(df: DataFrame, columns: Sequence[str], by: Sequence[str], size: int = SKETCH_SIZE) -> DataFrame:
    """(by, column_name, n, low, high, sketch) to be stored, for example one row a day: a few kilobytes for any number of rows.

    Sketches are built in the map tasks and merged; missing values and NaN are left out.  ``summary_stats`` is the exact way.
    """
    names = list(columns)
    values = [nan_to_null(F.col(name).cast("double")).alias(name) for name in names]
    long = df.select(*by, *values).unpivot(list(by), names, "column_name", "value").where("value IS NOT NULL")
    return long.groupBy(*by, "column_name").agg(
        F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high"),
        F.kll_sketch_agg_double("value", size).alias("sketch"))


def sketch_quantiles(sketches: DataFrame, by: Sequence[str], probabilities: dict[str, float]) -> DataFrame:
    """Stored sketches merged up to ``by`` (some of their keys): n, min, max and approximate quantiles per column."""
    merged = sketches.groupBy(*by, "column_name").agg(
        F.sum("n").alias("n"), F.min("low").alias("min"), F.max("high").alias("max"), F.kll_merge_agg_double("sketch").alias("sketch"))
    quantiles = [F.kll_sketch_get_quantile_double("sketch", F.lit(p)).alias(name) for name, p in probabilities.items()]
    return merged.select(*by, "column_name", "n", "min", "max", *quantiles)
