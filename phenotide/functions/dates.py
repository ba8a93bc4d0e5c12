"""Lenient dates and day arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DAYS_PER_YEAR = 365.25
# Dates that start with the day, and dates with slashes that start with the year; a time may follow.
_DAY_FIRST = r"^(\d{1,2})[/-](\d{1,2})[/-](\d{4})(?=$|[ T])"
_YEAR_FIRST = r"^(\d{4})/(\d{1,2})/(\d{1,2})(?=$|[ T])"
# A cast would also read a bare year or a year and month; those are not dates here.
_SHORTEST_DATE = 8


def parse_date(df: DataFrame, name: str) -> Column:
    """Column ``name`` as a date; text that is no date becomes null.

    Text is an ISO date or timestamp, or has slashes for dashes, or starts with the day
    (``03/05/2001`` and ``03-05-2001`` are the third of May), with or without a time behind it.
    """
    column = F.col(name)
    kind = df.schema[name].dataType
    if isinstance(kind, T.DateType):
        return column
    if not isinstance(kind, T.StringType):
        return column.cast("date")
    text = F.trim(column)
    iso = F.regexp_replace(F.regexp_replace(text, _YEAR_FIRST, "$1-$2-$3"), _DAY_FIRST, "$3-$2-$1")
    # Usual text is not searched: its first dash is behind the year.
    text = F.when(F.instr(text, "-") == 5, text).otherwise(iso)
    return F.when(F.length(text) >= _SHORTEST_DATE, text.try_cast("date"))


def parse_dates(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({name: parse_date(df, name) for name in names})


def add_days(date: Column, days: Column) -> Column:
    return F.date_add(date, days.try_cast("int"))


def subtract_days(date: Column, days: Column) -> Column:
    return F.date_sub(date, days.try_cast("int"))


def years_between(end: Column, start: Column) -> Column:
    """Whole days from ``start`` to ``end`` in years of 365.25 days."""
    return F.datediff(end, start) / F.lit(DAYS_PER_YEAR)


def is_before(left: Column, right: Column) -> Column:
    """``left < right`` where a missing date counts as not before."""
    return F.coalesce(left < right, F.lit(False))
