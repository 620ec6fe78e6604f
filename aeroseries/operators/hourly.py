"""Hourly means."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aeroseries.config import RATIOS
from aeroseries.functions.clock import floor_hour
from aeroseries.functions.numbers import ratio
from aeroseries.schema import present_gases


def _any_present(gases: Sequence[str]) -> Column:
    return F.coalesce(*gases).isNotNull()


def hourly_preaggregate(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean of each gas per IST hour, from rows with at least one gas.

    Date and hour of day follow from the hour, so they are neither read nor grouped by.
    """
    gases = present_gases(df)
    stored = "hour_start_ist" in df.columns
    hour = F.col("hour_start_ist") if stored else floor_hour(F.col("datetime_ist")).alias("hour_start_ist")
    means = df.where(_any_present(gases)).groupBy(*by, hour).agg(*(F.avg(gas).alias(gas) for gas in gases))
    return means.select(
        *by,
        "hour_start_ist",
        F.to_date("hour_start_ist").alias("date_ist"),
        F.hour("hour_start_ist").alias("hour_ist"),
        *gases,
    )


def hourly_means(df: DataFrame, time_name: str, by: Sequence[str] = ()) -> DataFrame:
    """Mean of each gas per hour, hours without a gas included."""
    return (
        df.where(F.col("datetime_ist").isNotNull())
        .groupBy(*by, floor_hour(F.col("datetime_ist")).alias(time_name))
        .agg(*(F.avg(gas).alias(gas) for gas in present_gases(df)))
    )


def fill_hours(hourly: DataFrame, time_name: str, by: Sequence[str] = ()) -> DataFrame:
    """Add the hours that are missing between the first and the last, with null gases.

    Each hour is followed by those up to the next one present, so the table is read once and joined with nothing. A gap is
    unrolled a thousand hours at a time: even a stray timestamp centuries away builds no long array.
    """
    gases = present_gases(hourly)
    following = F.lead(time_name).over(Window.partitionBy(*by).orderBy(time_name))
    gap = F.coalesce(F.timestamp_diff("HOUR", F.col(time_name), following), F.lit(1).cast("long"))
    steps = hourly.withColumn("_gap", gap)
    steps = steps.withColumn("_block", F.explode(F.expr("sequence(0L, (_gap - 1) div 1000)")))
    steps = steps.withColumn("_step", F.explode(F.expr("sequence(_block * 1000, least(_block * 1000 + 999, _gap - 1))")))
    at = F.timestamp_add("HOUR", F.col("_step"), F.col(time_name)).alias(time_name)
    return steps.select(*by, at, *(F.when(F.col("_step") == 0, F.col(gas)).alias(gas) for gas in gases))


def hourly_mean_timeseries(df: DataFrame, time_name: str = "hour_start_ist", by: Sequence[str] = ()) -> DataFrame:
    """Hourly means with every hour between the first and the last; hours without readings are null."""
    return fill_hours(hourly_means(df, time_name, by), time_name, by)


def gas_ratios(df: DataFrame) -> DataFrame:
    """Add CO/(CO+CO2) and CO2/(CO+CO2) where both gases are there."""
    if not {"co_sync", "co2_sync"} <= set(df.columns):
        return df
    co, co2 = F.col("co_sync"), F.col("co2_sync")
    return df.withColumns(
        {"co_over_co_plus_co2": ratio(co, co2), "co2_over_co_plus_co2": ratio(co2, co)}
    )


def correlation_frame(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Hourly means without empty hours, plus the ratio columns."""
    return with_ratios(hourly_means(df, "datetime_ist", by))


def with_ratios(hourly: DataFrame) -> DataFrame:
    """Hourly means that have a gas, with the ratio columns."""
    return gas_ratios(hourly.where(_any_present(present_gases(hourly))))


def columns_for(*names: str) -> list[str]:
    """The stored columns needed to show the given gases or ratios."""
    needed = {"datetime_ist", "date_ist", "hour_ist"}
    for name in names:
        needed.update(RATIOS.get(name, (name,)))
    return sorted(needed)
