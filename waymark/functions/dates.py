"""Dates of requests: parsing, defaults and closed ranges. Today is always a parameter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse(x: Column) -> Column:
    """Year, month and day with or without leading zeros; anything else, and dates that don't exist, give null."""
    return F.when(x.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), F.try_to_date(x, "yyyy-M-d"))


def day_count(start: Column, end: Column) -> Column:
    """Days of the closed range; not positive where the end lies before the start."""
    return F.datediff(end, start) + 1


def days(start: Column, end: Column, least: int = 0) -> Column:
    """The closed range in order; with fewer than ``least`` days so many from the start on (0: none)."""
    n = F.greatest(day_count(start, end), F.lit(least))
    return F.when(n > 0, F.sequence(start, F.date_add(start, n - 1))).otherwise(F.array().cast("array<date>"))


def request_range(start: Column, end: Column, today: Column) -> Column:
    """``start, end`` of a page request: a missing start is today, a missing end the start; bad text makes both today."""
    given = lambda x: F.length(F.coalesce(x, F.lit(""))) > 0
    bad = (given(start) & parse(start).isNull()) | (given(end) & parse(end).isNull())
    first = F.when(given(start), parse(start)).otherwise(today)
    last = F.when(given(end), parse(end)).otherwise(first)
    return F.struct(F.when(bad, today).otherwise(first).alias("start"), F.when(bad, today).otherwise(last).alias("end"))
