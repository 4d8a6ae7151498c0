"""News to companies and to the trading week that follows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickerloom.functions.dates import following_friday, in_range, week_end
from tickerloom.operators.joins import left_join_split
from tickerloom.params import NO_HEADLINE


def link_events(events: DataFrame, links: DataFrame) -> DataFrame:
    """Left join to the securities of the company; an event without a link stays, with nulls."""
    return events.join(links.dropDuplicates(), "gvkey", "left")


def add_situation(
    events: DataFrame, detail: DataFrame, estimation: tuple[str, str] | None = None
) -> DataFrame:
    """Left join of the situation text on event id and headline; missing headlines match each other.

    With ``estimation`` only details of events announced in that range are used, which leaves later
    events without a situation.
    """
    right = detail.select("keydevid", "headline", "situation")
    if estimation is not None:
        known = events.where(in_range(F.col("announcedate"), estimation)).select("keydevid")
        right = right.join(known.distinct(), "keydevid", "left_semi")
    return left_join_split(events, right, ["keydevid", "headline"], null_safe=True)


def news_for_next_week(bars: DataFrame, news: DataFrame, on: Sequence[str] = ("permco",)) -> DataFrame:
    """Each bar with every headline of the week before, or one placeholder row."""
    return with_headlines(bars, for_next_week(news, on), on)


def for_next_week(news: DataFrame, on: Sequence[str] = ("permco",)) -> DataFrame:
    """(on, end_date, headline): headlines with the week of the bars that they go to."""
    headline = F.coalesce("headline", F.lit(NO_HEADLINE)).alias("headline")
    return news.select(*on, following_friday(week_end(F.col("announcedate"))).alias("end_date"), headline)


def with_headlines(bars: DataFrame, dated: DataFrame, on: Sequence[str] = ("permco",)) -> DataFrame:
    """Each bar with every headline of ``dated`` for its week, or one placeholder row."""
    panel = left_join_split(bars, dated, [*on, "end_date"])
    return panel.withColumn("headline", F.coalesce("headline", F.lit(NO_HEADLINE)))
