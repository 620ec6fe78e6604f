"""Correlation and regression of gas pairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aeroseries.config import SUMMARY_PAIRS
from aeroseries.functions.numbers import pair_aggregates, pair_statistics

STATISTICS = ("n", "pearson_r", "slope", "intercept", "r2")


def pair_summaries(
    df: DataFrame, pairs: Sequence[tuple[str, str]], by: Sequence[str] = ()
) -> DataFrame:
    """One row per pair (and ``by`` key): n, Pearson r, slope, intercept, r2.

    All pairs share one aggregation with partial sums on the map side.
    """
    sums = df.groupBy(*by).agg(
        *(
            column.alias(f"_{i}_{name}")
            for i, (x, y) in enumerate(pairs)
            for name, column in pair_aggregates(x, y).items()
        )
    )
    rows = []
    for i, (x, y) in enumerate(pairs):
        known = {name: F.col(f"_{i}_{name}") for name in pair_aggregates(x, y)}
        stats = pair_statistics(known)
        rows.append(
            F.struct(
                F.lit(x).alias("x"),
                F.lit(y).alias("y"),
                *(stats[name].alias(name) for name in STATISTICS),
                known["min_x"].alias("min_x"),
                known["max_x"].alias("max_x"),
            )
        )
    return sums.select(*by, F.inline(F.array(*rows)))


def pair_stats(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Statistics of one pair over complete rows."""
    return pair_summaries(df, [(x, y)], by).select(*by, "x", "y", *STATISTICS)


def correlation_summary(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """CO against CO2 and CH4 against CO2."""
    return pair_summaries(df, SUMMARY_PAIRS, by).select(*by, "x", "y", *STATISTICS)


def monthly_correlation_summary(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The same per month."""
    return correlation_summary(df.where(F.col("month_ist").isNotNull()), [*by, "month_ist"])


def fit_line(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """End points of the fitted line at the least and the greatest x; empty below two pairs."""
    fit = pair_summaries(df, [(x, y)], by).where(F.col("n") >= 2)
    at = F.explode(F.array("min_x", "max_x")).alias("x")
    ends = fit.select(*by, "slope", "intercept", at)
    return ends.select(*by, "x", (F.col("slope") * F.col("x") + F.col("intercept")).alias("y"))


def scatter_points(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Complete pairs with the hour of day that colours them."""
    complete = F.col(x).isNotNull() & F.col(y).isNotNull() & F.col("datetime_ist").isNotNull()
    return df.where(complete).select(
        *by, F.col(x).alias("x"), F.col(y).alias("y"), F.hour("datetime_ist").alias("hour_ist")
    )
