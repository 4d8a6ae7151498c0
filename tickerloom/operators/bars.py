"""Daily prices to weekly bars and price direction."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickerloom.functions.dates import in_range, week_end, week_start
from tickerloom.functions.numbers import compound, nan_to_null, safe_ratio
from tickerloom.params import Periods

SECURITY = ("permco", "ticker")


def market_cap() -> Column:
    """Price times shares; the sign of the price is kept, NaN is missing."""
    return nan_to_null(F.col("prc") * F.col("shrout"))


def adjusted_price() -> Column:
    """Price over adjustment factor; missing for a zero factor."""
    return safe_ratio(F.col("prc"), F.col("cfacpr"))


def tradable(daily: DataFrame) -> DataFrame:
    """Positive price and a return; NaN counts as missing."""
    price, earned = nan_to_null(F.col("prc")), nan_to_null(F.col("ret"))
    return daily.where((price > 0) & earned.isNotNull())


def with_period(daily: DataFrame, periods: Periods, day: str = "date") -> DataFrame:
    """Tag rows as ``estimation`` or ``out_of_sample`` and drop the rest: one scan serves both periods."""
    label = F.when(in_range(F.col(day), periods.estimation), "estimation").when(
        in_range(F.col(day), periods.out_of_sample), "out_of_sample"
    )
    return daily.withColumn("period", label).where(F.col("period").isNotNull())


def weekly_bars(daily: DataFrame, extra_keys: Sequence[str] = (), order: Sequence[str] = ("rec_id", "rec_line")) -> DataFrame:
    """Last adjusted price and compounded percent return per security and Friday week.

    One hash aggregate with map-side combine, so a security with very many rows is reduced before the
    shuffle.  ``order`` breaks ties between records of the same day; the price itself is the last key.
    With one record per security and day pass no ``order``: a plain date lets Spark aggregate by hash, a
    struct makes it sort.  ``extra_keys`` (for example the period) become part of the group.
    """
    last_key = F.struct("date", *order, "adj") if order else F.col("date")
    return (
        tradable(daily)
        .withColumn("adj", adjusted_price())
        .withColumn("end_date", week_end(F.col("date")))
        .groupBy(*extra_keys, *SECURITY, "end_date")
        .agg(
            F.max_by("adj", last_key).alias("adj_prc"),
            (compound(F.col("ret")) * 100).alias("weekly_ret"),
        )
        .withColumn("start_date", week_start(F.col("end_date")))
    )


def direction(bars: DataFrame, extra_keys: Sequence[str] = ()) -> DataFrame:
    """'Down' when the price fell since the security's previous bar, else 'Up'; the first bar is 'Up'.

    The window holds the weeks of one security: bounded by the calendar, whatever the daily volume.
    """
    along = Window.partitionBy(*extra_keys, *SECURITY).orderBy("end_date")
    change = F.col("adj_prc") - F.lag("adj_prc").over(along)
    return bars.withColumn("direction", F.when(change < 0, "Down").otherwise("Up"))
