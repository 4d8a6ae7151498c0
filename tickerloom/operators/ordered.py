"""Order-sensitive operators that hold no whole group in one task.

A window over a group puts the group in one task.  Here the rows are range-sorted into buckets of even
size by (group, order keys), each bucket is worked on by itself, and what must cross a bucket border is
carried by a small table with a few rows per bucket.  The order keys must identify a row, otherwise
equal rows cannot be spread; use counts of distinct values where they repeat.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickerloom.session import pin

BUCKET = "_bucket"


def _bucketed(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows with the number of their range partition, pinned so that every later read sees the same one."""
    return pin(df.repartitionByRange(*keys).withColumn(BUCKET, F.spark_partition_id()), "buckets")


def running_total(
    df: DataFrame, within: Sequence[str], order: Sequence[str], weight: Column, out: str, total: str | None = None
) -> DataFrame:
    """Inclusive running sum of ``weight`` along ``order`` inside each ``within`` group (keys not null).

    ``total`` names a column for the sum of the whole group.  The table of bucket sums has at most one row
    per group and bucket it touches, so a window over the buckets of a group is small whatever its rows.
    """
    rows = _bucketed(df, [*within, *order])
    inside = Window.partitionBy(*within, BUCKET).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    buckets = Window.partitionBy(*within)
    earlier = buckets.orderBy(BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    extra = [F.sum("_sum").over(buckets).alias(total)] if total else []
    carried = (
        rows.groupBy(*within, BUCKET).agg(F.sum(weight).alias("_sum"))
        .select(*within, BUCKET, F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_carried"), *extra)
    )
    return (
        rows.withColumn(out, F.sum(weight).over(inside))
        .join(carried, [*within, BUCKET])
        .withColumn(out, F.col(out) + F.col("_carried"))
        .drop("_carried", BUCKET)
    )


def positions(df: DataFrame, within: Sequence[str], order: Sequence[str], out: str = "pos") -> DataFrame:
    """Position 1, 2, ... of each row of its group; ``order`` must identify a row."""
    return running_total(df, within, order, F.lit(1), out)


def exact_quantiles(df: DataFrame, by: Sequence[str], value: str, probabilities: dict[str, float]) -> DataFrame:
    """Quantiles with linear interpolation per group, one column per entry of ``probabilities``.

    Equal values are counted first, so a value that fills a third of the rows costs one row.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_n"))
    ranked = running_total(counts, by, [value], F.col("_n"), "_upto", "_total")

    def at(index: Column) -> Column:
        return F.max(F.when((F.col("_upto") - F.col("_n") <= index) & (index < F.col("_upto")), F.col(value)))

    picks, results = [], []
    for name, p in probabilities.items():
        place = (F.col("_total") - 1) * F.lit(p)
        picks += [
            at(F.floor(place)).alias(f"_lo_{name}"),
            at(F.ceil(place)).alias(f"_hi_{name}"),
            F.max(place - F.floor(place)).alias(f"_part_{name}"),
        ]
        low, high, part = (F.col(f"_{end}_{name}") for end in ("lo", "hi", "part"))
        results.append((low + (high - low) * part).alias(name))
    return ranked.groupBy(*by).agg(*picks).select(*by, *results)


def _tails(rows: DataFrame, keys: Sequence[str], value: str, reach: int) -> DataFrame:
    """(bucket, tail): the last ``reach`` rows (keys, value) before each bucket, in order.

    A bucket hands its own last rows to the next one by a join on the bucket number.  Only where buckets are shorter than
    ``reach`` the tails are joined on, to spans twice as long each time, until all are full or begin at the first bucket.
    """
    fields = list(dict.fromkeys([*keys, value]))
    from_end = Window.partitionBy(BUCKET).orderBy(*[F.col(key).desc() for key in keys])
    ends = rows.select(BUCKET, *fields).withColumn("_r", F.row_number().over(from_end)).where(F.col("_r") <= reach)
    own = ends.groupBy(BUCKET).agg(F.array_sort(F.collect_list(F.struct((-F.col("_r")).alias("_r"), *fields))).alias("tail"))
    buckets = (rows.agg(F.max(BUCKET)).first()[0] or 0) + 1  # range partitions; some may be empty
    grid = rows.sparkSession.range(buckets).select(F.col("id").cast("int").alias(BUCKET))
    tails = pin(grid.join(own, BUCKET, "left").withColumn("tail", F.coalesce("tail", F.array().cast(own.schema["tail"].dataType))), "tails")
    span = 1  # buckets that a tail has looked at

    def before(distance: int) -> DataFrame:
        return tails.select((F.col(BUCKET) + distance).alias(BUCKET), F.col("tail").alias("earlier"))

    while span < buckets and tails.where((F.size("tail") < reach) & (F.col(BUCKET) >= span)).count():
        both = F.concat(F.coalesce("earlier", F.array().cast(own.schema["tail"].dataType)), "tail")
        joined = tails.join(before(span), BUCKET, "left").withColumn("tail", F.slice(both, F.greatest(F.size(both) - reach, F.lit(0)) + 1, F.lit(reach)))
        tails = pin(joined.select(BUCKET, "tail"), "tails")
        span *= 2
    return before(1).where(F.size("earlier") > 0).select(BUCKET, F.col("earlier").alias("tail"))


def rolling_mean(
    df: DataFrame, value: str, within: Sequence[str], order: Sequence[str], size: int, out: str
) -> DataFrame:
    """Mean of the last ``size`` rows; null unless all of them are there with a value.

    Each bucket also gets the ``size - 1`` rows that come before it, wherever they lie; see ``_tails``.
    """
    reach = size - 1
    keys = [*within, *order]
    rows = _bucketed(df, keys)
    halo = _tails(rows, keys, value, reach).select(BUCKET, F.explode("tail").alias("_h")).select(BUCKET, "_h.*", F.lit(True).alias("_is_halo"))
    both = rows.withColumn("_is_halo", F.lit(False)).unionByName(halo.drop("_r"), allowMissingColumns=True)
    frame = Window.partitionBy(BUCKET, *within).orderBy(*order).rowsBetween(-reach, 0)
    return (
        both.withColumn(out, F.when(F.count(value).over(frame) == size, F.avg(value).over(frame)))
        .where(~F.col("_is_halo"))
        .drop("_is_halo", BUCKET)
    )
