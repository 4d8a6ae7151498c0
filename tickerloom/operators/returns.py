"""Size classes, transaction costs, weekly and market returns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickerloom.functions.dates import calendar_week
from tickerloom.functions.numbers import compound, safe_ratio
from tickerloom.operators.bars import market_cap
from tickerloom.operators.cleaning import drop_incomplete
from tickerloom.operators.ordered import exact_quantiles
from tickerloom.params import EXCHANGE, GROSS, LARGE_COST, NET, SMALL_COST


def size_class(daily: DataFrame, exchange: int = EXCHANGE) -> DataFrame:
    """'Large' at or above the day's median market cap among the securities of one exchange, else 'Small'."""
    rows = drop_incomplete(daily.where(F.col("exchcd") == exchange), ["prc", "shrout", "date"])
    rows = rows.withColumn("cap", market_cap())
    medians = exact_quantiles(rows.select("date", "cap"), ["date"], "cap", {"median_cap": 0.5})
    return rows.join(medians, "date").withColumn(
        "size_class", F.when(F.col("cap") >= F.col("median_cap"), "Large").otherwise("Small")
    )


def class_per_day(classes: DataFrame) -> DataFrame:
    """One class per day and ticker; 'Large' wins where records differ, so that the join adds no rows."""
    return classes.groupBy("date", "ticker").agg(F.min("size_class").alias("size_class"))


def transaction_cost() -> Column:
    """Cost of one trade; everything that is not 'Large', unknown included, pays the small-company cost."""
    return F.when(F.col("size_class") == "Large", LARGE_COST).otherwise(SMALL_COST)


def period_return(panel: DataFrame) -> DataFrame:
    """(ticker, start_date, price, n_rows, ret): price change since the ticker's previous week.

    The panel may have a row per headline; each week is first reduced to one price (of the highest
    permco), so the window holds weeks and not headlines.
    """
    weeks = panel.groupBy("ticker", "start_date").agg(
        F.max_by("adj_prc", "permco").alias("price"), F.count("*").alias("n_rows")
    )
    along = Window.partitionBy("ticker").orderBy("start_date")
    change = safe_ratio(F.col("price"), F.lag("price").over(along)) - 1.0
    return weeks.withColumn("ret", change)


def net_returns(returns: DataFrame, classes: DataFrame, cost_per_row: bool = False) -> DataFrame:
    """Returns with size class, cost and return after cost; a week start without a class pays the small cost.

    With ``cost_per_row`` the cost is charged for every panel row of the week.  The first row of a week
    carries the return and the others zero, so their product has a closed form; in a ticker's first week
    only the other rows count.
    """
    kept = returns.where(F.col("ret").isNotNull() | ((F.col("n_rows") > 1) & F.lit(cost_per_row)))
    daily = class_per_day(classes).withColumnRenamed("date", "start_date")
    priced = kept.join(daily, ["start_date", "ticker"], "left").withColumn("cost", transaction_cost())
    if not cost_per_row:
        return priced.withColumn("net_ret", F.col("ret") - F.col("cost"))
    first_row = F.coalesce(1.0 + F.col("ret") - F.col("cost"), F.lit(1.0))
    others = F.pow(1.0 - F.col("cost"), F.col("n_rows") - 1)
    return priced.withColumn("net_ret", first_row * others - 1.0).withColumn("ret", F.coalesce("ret", F.lit(0.0)))


def weekly_compound(returns: DataFrame) -> DataFrame:
    """(week, ticker, ret, net_ret): product of one plus return per Monday-to-Sunday week, as a fraction."""
    return returns.groupBy(calendar_week(F.col("start_date")).alias("week"), "ticker").agg(
        compound(F.col("ret")).alias("ret"), compound(F.col("net_ret")).alias("net_ret")
    )


def by_scenario(weekly: DataFrame) -> DataFrame:
    """Gross and net returns as rows (scenario, week, ticker, ret)."""
    named = weekly.select("week", "ticker", F.col("ret").alias(GROSS), F.col("net_ret").alias(NET))
    return named.unpivot(["week", "ticker"], [GROSS, NET], "scenario", "ret")


def market_return(returns: DataFrame, keys: Sequence[str] = ("week",)) -> DataFrame:
    """Plain mean over the tickers present in the week."""
    return returns.groupBy(*keys).agg(F.avg("ret").alias("ret"))


def returns_matrix(returns: DataFrame, columns: Sequence[str], column_key: str = "ticker", value: str = "ret") -> DataFrame:
    """Week x column matrix of ``value`` for export; the columns are given, so no pass is spent on finding them."""
    return returns.groupBy("week").pivot(column_key, list(columns)).agg(F.first(value))
