"""Daily prices and news to the weekly stock/headline panel."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickerloom.functions.dates import quarter_index
from tickerloom.operators.bars import direction, weekly_bars, with_period
from tickerloom.operators.cleaning import label_code
from tickerloom.operators.news import for_next_week, news_for_next_week, with_headlines
from tickerloom.operators.sizing import Compact
from tickerloom.operators.vectors import VARIANTS, add_variants, stack_variants
from tickerloom.params import Periods
from tickerloom.session import pin


def period_bars(daily: DataFrame, periods: Periods) -> DataFrame:
    """Weekly bars with direction, the two periods side by side: each starts with a first bar of its own."""
    return direction(weekly_bars(with_period(daily, periods), ["period"]), ["period"])


def period_panel(daily: DataFrame, news: DataFrame, periods: Periods) -> DataFrame:
    """Bars of each period with the headlines of the week before; news stays in its own period."""
    dated = with_period(news, periods, "announcedate")
    return news_for_next_week(period_bars(daily, periods), dated, ["period", "permco"])


def labelled_rows(panel: DataFrame) -> DataFrame:
    """The distinct headline rows of a panel, which ``row_vectors`` turns to vectors."""
    return panel.select("period", "permco", "ticker", "start_date", "headline", "direction").dropDuplicates()


def written_label_rows(daily: DataFrame, news: DataFrame, periods: Periods) -> DataFrame:
    """``labelled_rows`` of ``period_panel``, written, with less on disk at a time: the distinct headlines of the weeks and the
    bars are written before they meet.  A bar occurs once and so does a headline of a week, so the rows differ."""
    on = ["period", "permco"]
    dated = pin(for_next_week(with_period(news, periods, "announcedate"), on).distinct(), "week-news")
    bars = pin(period_bars(daily, periods).select(*on, "ticker", "start_date", "end_date", "direction"), "bars")
    panel = with_headlines(bars, dated, on)
    return pin(panel.select("period", "permco", "ticker", "start_date", "headline", "direction"), "rows")


def row_vectors(rows: DataFrame, variants: dict[str, tuple[str, int]] = VARIANTS) -> DataFrame:
    """One row per headline row and encoder variant: ids, quarter, label and features."""
    vectors = stack_variants(add_variants(rows, "headline", variants), variants)
    return vectors.select(
        "period", "permco", "model", "ticker", "start_date", "headline",
        quarter_index(F.col("start_date")).alias("unit"),
        label_code(F.col("direction")).alias("label"), "features",
    )


def compact_vectors(rows: DataFrame, variants: dict[str, tuple[str, int]] = VARIANTS) -> Compact:
    """The rows of ``labelled_rows``, whose vectors are made in the tasks that fit the models of a company."""
    return Compact(rows, ["permco"], lambda df: row_vectors(df, variants), max(width for _, width in variants.values()))
