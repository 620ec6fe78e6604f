"""Hour-of-day statistics.

The hour-by-date matrix stays long (one row per cell). It has at most 24 rows per day, so medians over its rows or
columns run over days and hours, never over readings. ``by`` names columns that tell instruments apart.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aeroseries.schema import present_gases

DAYS = tuple(range(1, 32))


def diurnal_matrix(df: DataFrame, gas: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean per date and hour; a cell whose readings are all missing is null."""
    placed = df.where(F.col("date_ist").isNotNull() & F.col("hour_ist").isNotNull())
    return placed.groupBy(*by, "date_ist", "hour_ist").agg(F.avg(gas).alias(gas))


def diurnal_pivot(df: DataFrame, gas: str, dates: Sequence[date] | None = None, by: Sequence[str] = ()) -> DataFrame:
    """The matrix with one column per date, for display: the listed dates, else all that occur."""
    if dates is None:
        dates = sorted(row[0] for row in df.select("date_ist").where("date_ist IS NOT NULL").distinct().collect())
    cells = diurnal_matrix(df, gas, by).withColumn("_date", F.col("date_ist").cast("string"))
    return cells.groupBy(*by, "hour_ist").pivot("_date", [str(d) for d in dates]).agg(F.first(gas, True))


def range_24_point(matrix: DataFrame, gas: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean over days of the hourly cells."""
    return matrix.groupBy(*by, "hour_ist").agg(F.avg(gas).alias(f"avg_{gas}"))


def diurnal_stats(matrix: DataFrame, gas: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean, median and sample SD over days per hour, with the mean +- SD band; SD of one day is 0."""
    stats = matrix.groupBy(*by, "hour_ist").agg(
        F.avg(gas).alias("mean"),
        F.median(gas).alias("median"),
        F.coalesce(F.stddev_samp(gas), F.lit(0.0)).alias("std"),
    )
    return stats.withColumns(
        {"upper": F.col("mean") + F.col("std"), "lower": F.col("mean") - F.col("std")}
    )


def daily_mean_median(matrix: DataFrame, gas: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean and median of each day's hourly cells."""
    return matrix.groupBy(*by, "date_ist").agg(F.avg(gas).alias("mean"), F.median(gas).alias("median"))


def profile_24_point(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean of the readings per hour of day, all gases."""
    placed = df.where(F.col("hour_ist").isNotNull())
    return placed.groupBy(*by, "hour_ist").agg(*(F.avg(gas).alias(gas) for gas in present_gases(df)))


def monthly_diurnal(df: DataFrame, gas: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean per month and hour of day."""
    return monthly_diurnal_all(df, by).select(*by, "month_ist", "hour_ist", gas)


def monthly_diurnal_all(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The same for all gases at once, in one pass over the readings."""
    placed = df.where(F.col("month_ist").isNotNull() & F.col("hour_ist").isNotNull())
    return placed.groupBy(*by, "month_ist", "hour_ist").agg(*(F.avg(gas).alias(gas) for gas in present_gases(df)))


def month_hour_day(df: DataFrame, gas: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean per month, hour and day of month, in long form, without empty cells."""
    cells = df.groupBy(*by, "month_ist", "hour_ist", "day_ist").agg(F.avg(gas).alias(gas))
    return cells.dropna(subset=["month_ist", "hour_ist", "day_ist", gas])


def month_hour_day_matrix(df: DataFrame, gas: str, by: Sequence[str] = ()) -> DataFrame:
    """The same with one column per day, ``1`` to ``31``."""
    cells = month_hour_day(df, gas, by)
    return cells.groupBy(*by, "month_ist", "hour_ist").pivot("day_ist", list(DAYS)).agg(F.first(gas, True))
