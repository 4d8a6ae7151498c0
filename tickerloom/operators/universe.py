"""Industry filter, price-name join and the company universe."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickerloom.functions.dates import in_range
from tickerloom.operators.bars import market_cap
from tickerloom.params import SIC_BAND, UNIVERSE_SIZE

# The price-name join as SQL over the views daily_prices and stock_names.  Without a validity condition
# a security with k name records yields k copies of each day.
DAILY_PANEL_SQL = """
    SELECT p.permno, p.permco, n.comnam, n.ticker, p.date, p.prc, p.shrout, p.cfacpr, p.ret
    FROM daily_prices p JOIN stock_names n ON p.permno = n.permno
    WHERE n.siccd BETWEEN :sic_low AND :sic_high
      AND p.date BETWEEN CAST(:first_day AS DATE) AND CAST(:last_day AS DATE)
"""
DAILY_PANEL_ASOF_SQL = DAILY_PANEL_SQL + "      AND p.date BETWEEN n.namedt AND n.nameendt\n"


def in_industry(df: DataFrame, band: tuple[int, int] = SIC_BAND) -> DataFrame:
    return df.where(F.col("siccd").between(*band))


def average_market_cap(daily: DataFrame) -> DataFrame:
    """Mean market cap and one name per security; the smallest name makes it deterministic."""
    return (
        daily.where(F.col("permno").isNotNull()).groupBy("permno")
        .agg(F.avg(market_cap()).alias("avg_cap"), F.min("comnam").alias("comnam"))
    )


def market_cap_by_day(daily: DataFrame) -> DataFrame:
    return daily.groupBy("date").agg(F.avg(market_cap()).alias("avg_cap"))


def top_universe(daily: DataFrame, estimation: tuple[str, str], size: int = UNIVERSE_SIZE) -> DataFrame:
    """The largest securities by mean market cap in the estimation period; ties by permno."""
    base = daily.where(in_range(F.col("date"), estimation))
    return average_market_cap(base).orderBy(F.desc_nulls_last("avg_cap"), F.asc("permno")).limit(size)


def keep_listed(df: DataFrame, keys: DataFrame, on: str) -> DataFrame:
    """Rows whose key is in ``keys``; the keys stay a frame and are never collected."""
    return df.join(keys.select(on), on, "left_semi")


def first_rows(df: DataFrame, order: list[str], k: int) -> DataFrame:
    """First ``k`` rows in the given order."""
    return df.orderBy(*order).limit(k)
