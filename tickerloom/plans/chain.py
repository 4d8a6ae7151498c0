"""The whole study in one piece: universe, linked news, panel with moving average, and portfolios of the universe."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickerloom.functions.dates import in_range
from tickerloom.functions.numbers import coerce_day, coerce_double
from tickerloom.operators.bars import weekly_bars
from tickerloom.operators.cleaning import PANEL_COLUMNS
from tickerloom.operators.news import link_events
from tickerloom.operators.ordered import rolling_mean
from tickerloom.operators.portfolio import risk_table
from tickerloom.operators.returns import net_returns, period_return, size_class, weekly_compound
from tickerloom.operators.universe import in_industry, keep_listed, top_universe
from tickerloom.params import LEG_SIZE, MOVING_AVERAGE_ROWS, UNIVERSE_SIZE, Periods
from tickerloom.plans.panel import period_panel
from tickerloom.plans.report import portfolio_series
from tickerloom.session import pin


def listed_securities(daily: DataFrame, periods: Periods, size: int = UNIVERSE_SIZE) -> DataFrame:
    """The largest securities of the industry in the estimation period; written, as everything else is filtered by it."""
    return pin(top_universe(in_industry(daily), periods.estimation, size), "universe")


def universe_panel(daily: DataFrame, events: DataFrame, links: DataFrame, listed: DataFrame, periods: Periods) -> DataFrame:
    """Panel rows of the listed securities with the mean price of the last rows of the security and period.

    Events reach a security through the link table; events of companies without a link, or linked to securities that
    are not listed, are left out.
    """
    prices = keep_listed(daily, listed, "permno")
    linked = link_events(events, links).withColumnRenamed("lpermno", "permno")
    news = keep_listed(linked, listed, "permno").select(F.col("lpermco").alias("permco"), "announcedate", "headline")
    rows = pin(period_panel(prices, news, periods).select("period", *PANEL_COLUMNS).dropDuplicates(), "universe-panel")
    return rolling_mean(rows, "adj_prc", ["period", "permco", "ticker"], ["end_date", "headline"], MOVING_AVERAGE_ROWS, "ma5")


def sizes_from_file(lines: DataFrame) -> DataFrame:
    """(date, ticker, exchcd, prc, shrout) from the text columns of a size file; what does not parse is missing."""
    return lines.select(
        coerce_day(F.col("date")).alias("date"), F.col("TICKER").alias("ticker"), F.col("EXCHCD").alias("exchcd"),
        coerce_double(F.col("PRC")).alias("prc"), coerce_double(F.col("SHROUT")).alias("shrout"))


def universe_risk(daily: DataFrame, predictions: DataFrame, size_lines: DataFrame, listed: DataFrame, periods: Periods, leg_size: int = LEG_SIZE) -> DataFrame:
    """Risk table of the listed securities in the out-of-sample period, costs by the classes of the size file."""
    later = keep_listed(daily, listed, "permno").where(in_range(F.col("date"), periods.out_of_sample))
    classes = size_class(sizes_from_file(size_lines).where(in_range(F.col("date"), periods.out_of_sample)))
    weekly = pin(weekly_compound(net_returns(period_return(weekly_bars(later)), classes)), "weekly")
    return risk_table(portfolio_series(predictions, weekly, leg_size))
