"""Date and hour ranges."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aeroseries.config import GASES
from aeroseries.functions.clock import as_date
from aeroseries.functions.numbers import to_number
from aeroseries.operators.report import summarize


def filter_by_date_range(df: DataFrame, start: date | str, end: date | str) -> DataFrame:
    """Rows of the IST dates from start to end, both included."""
    return df.where(F.col("date_ist").between(F.lit(as_date(start)), F.lit(as_date(end))))


def filter_by_hours(df: DataFrame, first: int, last: int, time: str = "datetime_ist") -> DataFrame:
    """Rows whose hour of day lies between two hours, given in any order."""
    return df.where(F.hour(time).between(min(first, last), max(first, last)))


def clamp_range(df: DataFrame, start: date | str, end: date | str) -> DataFrame:
    """One row with the range moved into the data's bounds and put in order; null without data."""

    def inside(day):
        return F.least(F.greatest(F.lit(as_date(day)), F.col("min_date")), F.col("max_date"))

    known = F.col("min_date").isNotNull()
    bounds = summarize(df)
    moved = bounds.select(
        F.when(known, inside(start)).alias("a"), F.when(known, inside(end)).alias("b")
    )
    return moved.select(F.least("a", "b").alias("start_date"), F.greatest("a", "b").alias("end_date"))


def resolve_range(df: DataFrame, start: date | str, end: date | str) -> tuple[date, date] | None:
    """The clamped range as dates, so that later filters are literals a scan can use; None without data."""
    row = clamp_range(df, start, end).first()
    return (row.start_date, row.end_date) if row.start_date is not None else None


def default_day(df: DataFrame) -> DataFrame:
    """Rows of the first day only, as shown on start."""
    first = df.agg(F.min("date_ist")).scalar()
    return df.where(F.col("date_ist") == first)


def full_range(df: DataFrame) -> tuple[date, date] | None:
    """First and last date; None without data."""
    row = summarize(df).first()
    return (row.min_date, row.max_date) if row.min_date is not None else None


def normalize_frame(df: DataFrame, start: date | str, end: date | str) -> DataFrame:
    """Coerce types of a loaded frame, drop rows without a time, keep the range.

    Hourly frames carry ``hour_start_ist``, which becomes ``datetime_ist``.
    """
    coerced = {}
    if "hour_start_ist" in df.columns:
        coerced["datetime_ist"] = F.col("hour_start_ist").try_cast("timestamp_ntz")
    elif "datetime_ist" in df.columns:
        coerced["datetime_ist"] = F.col("datetime_ist").try_cast("timestamp_ntz")
    else:
        return df
    if "date_ist" in df.columns:
        coerced["date_ist"] = F.col("date_ist").try_cast("date")
    if "hour_ist" in df.columns:
        coerced["hour_ist"] = F.col("hour_ist").try_cast("int")
    for gas in GASES:
        if gas in df.columns:
            coerced[gas] = to_number(F.col(gas)) if dict(df.dtypes)[gas] == "string" else F.col(gas)
    df = df.withColumns(coerced).where(F.col("datetime_ist").isNotNull())
    return filter_by_date_range(df, start, end) if "date_ist" in df.columns else df
