"""Wall-clock expressions on ``timestamp_ntz``; none of them depends on the session time zone."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F


def utc_to_ist(ts: Column) -> Column:
    """India has kept one offset, without daylight saving, since 1945; adding it is cheaper than a zone lookup."""
    return ts + F.expr("INTERVAL '05:30' HOUR TO MINUTE")


def floor_hour(ts: Column) -> Column:
    return F.timestamp_add("HOUR", F.hour(ts), F.to_date(ts).cast("timestamp_ntz"))


def month_key(day: Column) -> Column:
    """``YYYY-MM`` of a date."""
    return F.substring(day.cast("string"), 1, 7)


def calendar(ist: Column) -> dict[str, Column]:
    """The IST calendar columns of a timestamp."""
    day = F.to_date(ist)
    return {
        "hour_start_ist": floor_hour(ist),
        "date_ist": day,
        "hour_ist": F.hour(ist),
        "day_ist": F.dayofmonth(day),
        "month_ist": month_key(day),
    }


def month_label(month: Column) -> Column:
    """``Nov 2025`` for ``2025-11``."""
    return F.date_format(F.to_date(month, "yyyy-MM"), "MMM yyyy")


def in_months(start: date, end: date) -> Column:
    """Partition predicate for the months that a date range touches."""
    year, month = F.col("year"), F.col("month")
    after = (year > start.year) | ((year == start.year) & (month >= start.month))
    before = (year < end.year) | ((year == end.year) & (month <= end.month))
    return after & before


def as_date(value: date | str) -> date:
    return value if isinstance(value, date) else date.fromisoformat(value)
