"""One-row figures shown beside each view, one for each instrument where ``by`` tells them apart."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def diurnal_summary(stats: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Over the 24 hourly rows: mean of means, median of medians, mean SD, hours."""
    return stats.groupBy(*by).agg(
        F.avg("mean").alias("avg_mean"),
        F.median("median").alias("median_median"),
        F.avg("std").alias("avg_std"),
        F.count("*").alias("hours"),
    )


def daily_summary(daily: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Over days: count, mean of means, mean of medians, least and greatest mean."""
    return daily.groupBy(*by).agg(
        F.count("*").alias("days"),
        F.avg("mean").alias("avg_mean"),
        F.avg("median").alias("avg_median"),
        F.min("mean").alias("min_mean"),
        F.max("mean").alias("max_mean"),
    )


def hourly_summary(hourly: DataFrame, gas: str, by: Sequence[str] = ()) -> DataFrame:
    """Over a gap-filled series: points, gaps included, and mean, least and greatest hourly mean."""
    return hourly.groupBy(*by).agg(
        F.count("*").alias("points"),
        F.avg(gas).alias("mean"),
        F.min(gas).alias("min"),
        F.max(gas).alias("max"),
    )


def heatmap_summary(matrix: DataFrame, gas: str, by: Sequence[str] = ()) -> DataFrame:
    """Over the matrix's finite cells: count, least, mean, greatest."""
    finite = F.when(F.abs(gas) < F.lit(float("inf")), F.col(gas)).alias(gas)
    return matrix.select(*by, finite).groupBy(*by).agg(
        F.count(gas).alias("cells"),
        F.min(gas).alias("min"),
        F.avg(gas).alias("mean"),
        F.max(gas).alias("max"),
    )
