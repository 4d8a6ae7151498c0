"""Week keys.  A trading week is closed by its Friday; a calendar week starts on Monday."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def week_end(day: Column) -> Column:
    """The first Friday on or after ``day``; Saturday and Sunday belong to the next Friday."""
    return F.next_day(F.date_sub(day, 1), "FRI")


def week_start(friday: Column) -> Column:
    """Monday of the week that ends on ``friday``."""
    return F.date_sub(friday, 4)


def following_friday(friday: Column) -> Column:
    return F.date_add(friday, 7)


def calendar_week(day: Column) -> Column:
    """Monday of the Monday-to-Sunday week of ``day``."""
    return F.to_date(F.date_trunc("week", day))


def year_of(day: Column) -> Column:
    return F.year(day)


def quarter_index(day: Column) -> Column:
    """Quarters since year 0, a fold unit for short histories."""
    return F.year(day) * 4 + F.quarter(day) - 1


def in_range(day: Column, bounds: tuple[str, str]) -> Column:
    """``day`` within ISO date bounds, both ends included."""
    return day.between(F.lit(bounds[0]).cast("date"), F.lit(bounds[1]).cast("date"))
