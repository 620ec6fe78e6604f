"""Bounds, months, partitions and data quality."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aeroseries.config import GASES
from aeroseries.functions.clock import month_label

# Report columns and the flags they count.
FLAG_COUNTS = {
    "hard_flags": "flag_hard",
    "point_spikes": "flag_point_spike",
    "hourly_spikes": "flag_hourly_spike",
    "sustained_shifts": "flag_sustained_shift",
    "excluded_points": "qc_excluded",
}


def summarize(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """First date, last date and row count."""
    return df.groupBy(*by).agg(
        F.min("date_ist").alias("min_date"),
        F.max("date_ist").alias("max_date"),
        F.count("*").alias("row_count"),
    )


def available_months(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Months with their label and first and last date."""
    months = df.groupBy(*by, "month_ist").agg(
        F.min("date_ist").alias("min_date"), F.max("date_ist").alias("max_date")
    )
    return months.select(*by, "month_ist", month_label(F.col("month_ist")).alias("label"), "min_date", "max_date")


def partition_stats(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rows and date bounds of each year and month."""
    return df.groupBy(*by, "year", "month").agg(
        F.count("*").alias("row_count"),
        F.min("date_ist").alias("min_date"),
        F.max("date_ist").alias("max_date"),
    )


def _percent(part: Column, whole: Column) -> Column:
    return F.try_divide(part * 100.0, whole)


def quality_report(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row per gas, and one for the timestamps, of each instrument where ``by`` tells them apart.

    The gases share one aggregation without a shuffle of readings. Repeated timestamps are counted apart, over
    the timestamp column alone.
    """
    sums = {"rows": F.count("*")}
    for gas in GASES:
        raw = f"{gas}_raw" if f"{gas}_raw" in df.columns else gas
        sums |= {
            f"{gas}_raw_missing": F.count_if(F.col(raw).isNull()),
            f"{gas}_clean_missing": F.count_if(F.col(gas).isNull()),
            f"{gas}_raw_min": F.min(raw),
            f"{gas}_raw_max": F.max(raw),
            f"{gas}_clean_min": F.min(gas),
            f"{gas}_clean_max": F.max(gas),
            f"{gas}_clean_mean": F.avg(gas),
        }
        for name, flag in FLAG_COUNTS.items():
            column = f"{gas}_{flag}"
            sums[f"{gas}_{name}"] = F.count_if(column) if column in df.columns else F.lit(0).cast("long")
    flat = df.groupBy(*by).agg(*(column.alias(name) for name, column in sums.items()))
    rows = []
    for gas in GASES:
        parts = {
            "raw_missing": F.col(f"{gas}_raw_missing"),
            "raw_missing_pct": _percent(F.col(f"{gas}_raw_missing"), F.col("rows")),
            "clean_missing": F.col(f"{gas}_clean_missing"),
            "clean_missing_pct": _percent(F.col(f"{gas}_clean_missing"), F.col("rows")),
            **{name: F.col(f"{gas}_{name}") for name in FLAG_COUNTS},
            **{
                name: F.col(f"{gas}_{name}")
                for name in ("raw_min", "raw_max", "clean_min", "clean_max", "clean_mean")
            },
        }
        rows.append(F.struct(F.lit(gas).alias("column"), "rows", *(c.alias(n) for n, c in parts.items())))
    gases = flat.select(*by, F.inline(F.array(*rows)))
    times = df.groupBy(*by, "datetime_utc").count().groupBy(*by).agg(
        F.lit("datetime_utc").alias("column"),
        F.coalesce(F.sum("count"), F.lit(0)).alias("rows"),
        F.coalesce(F.sum(F.when(F.col("datetime_utc").isNull(), F.col("count"))), F.lit(0)).alias(
            "clean_missing"
        ),
        F.coalesce(F.sum(F.col("count") - 1), F.lit(0)).alias("duplicate_rows"),
    )
    times = times.withColumn("clean_missing_pct", _percent(F.col("clean_missing"), F.col("rows")))
    return gases.unionByName(times, allowMissingColumns=True)
