"""Numeric expressions with the null rules of the analysis: missing in, missing out, no errors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


# Forms of a day, most specific first; month before day where slashes leave it open.
DAY_FORMATS = [
    (r"\d{4}-\d{1,2}-\d{1,2}", "yyyy-M-d"),
    (r"\d{8}", "yyyyMMdd"),
    (r"\d{4}/\d{1,2}/\d{1,2}", "yyyy/M/d"),
    (r"\d{1,2}/\d{1,2}/\d{4}", "M/d/yyyy"),
]
# A time of day that may follow, with or without a zone; the day is that of the clock reading.
TIME_FORM = r"[T ]([01]?\d|2[0-3]):[0-5]\d(:[0-5]\d(\.\d+)?)?( ?(Z|[+-]\d{2}:?\d{2}))?"


def safe_ratio(numerator: Column, denominator: Column) -> Column:
    """Quotient, null for a zero denominator."""
    return F.try_divide(numerator, denominator)


def ratio_or_zero(numerator: Column, denominator: Column) -> Column:
    """Quotient where 0/0 counts as 0, the convention of precision, recall and F1."""
    return F.coalesce(F.try_divide(numerator, denominator), F.lit(0.0))


def nan_to_null(value: Column) -> Column:
    return F.when(~F.isnan(value), value)


def compound(returns: Column) -> Column:
    """Aggregate: product of (1 + r) minus 1 over the non-null returns; 0 for a group without any."""
    return F.coalesce(F.product(F.lit(1.0) + returns) - 1.0, F.lit(0.0))


def coerce_double(text: Column) -> Column:
    """Text to number, null where the text is no number."""
    return text.try_cast("double")


def coerce_day(text: Column) -> Column:
    """Text to date in one of DAY_FORMATS, with or without a time, which must fit whole; null for all other text."""
    tries = [
        F.when(text.rlike(f"^{form}({TIME_FORM})?$"), F.try_to_timestamp(F.regexp_extract(text, f"^{form}", 0), F.lit(pattern)).cast("date"))
        for form, pattern in DAY_FORMATS
    ]
    return F.coalesce(*tries)


def strict_day(text: Column) -> Column:
    """Text to date; the query fails on text that is no date."""
    return F.to_date(text)


def wall_clock(text: Column) -> Column:
    """Text to a zone-free timestamp: the zone is dropped, the clock reading is kept."""
    return text.try_cast("timestamp_ntz")


def argmax(scores: Column) -> Column:
    """Zero-based position of the first maximum of an array."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def dot(left: Column, right: Column) -> Column:
    """Inner product of two arrays of the same length."""
    products = F.zip_with(left, right, lambda a, b: a * b)
    return F.aggregate(products, F.lit(0.0), lambda total, value: total + value)
