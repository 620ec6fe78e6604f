"""Numeric expressions: missing values, coercion, regression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F



def nan_to_null(value: Column) -> Column:
    return F.nanvl(value, F.lit(None).cast("double"))


def to_number(text: Column) -> Column:
    """Double, or null when the text is not a number.

    A plain cast would also take ``1.5f``, ``1.5d`` and hexadecimal literals.
    """
    text = text.cast("string")
    literal_suffix = text.rlike(r"[0-9.][dDfF]\s*$|[xX]")
    return nan_to_null(F.when(~literal_suffix, text.try_cast("double")))


def ratio(part: Column, other: Column) -> Column:
    """``part / (part + other)`` where the sum is positive."""
    total = part + other
    return F.when(total > 0, part / total)


def pair_aggregates(x: str, y: str) -> dict[str, Column]:
    """Regression sums over the rows where both columns are present."""
    complete = F.col(x).isNotNull() & F.col(y).isNotNull()
    xs, ys = F.when(complete, F.col(x)), F.when(complete, F.col(y))
    return {
        "n": F.count(xs),
        "mean_x": F.avg(xs),
        "mean_y": F.avg(ys),
        "var_x": F.var_pop(xs),
        "var_y": F.var_pop(ys),
        "cov": F.covar_pop(xs, ys),
        "min_x": F.min(xs),
        "max_x": F.max(xs),
    }


def pair_statistics(sums: dict[str, Column]) -> dict[str, Column]:
    """Pearson r, least-squares line and r2; null below two pairs or without variance."""
    enough = sums["n"] >= 2
    spread = sums["var_x"] * sums["var_y"]
    slope = F.try_divide(sums["cov"], sums["var_x"])
    return {
        "n": sums["n"],
        "pearson_r": F.when(enough, F.try_divide(sums["cov"], F.sqrt(spread))),
        "slope": F.when(enough, slope),
        "intercept": F.when(enough, sums["mean_y"] - slope * sums["mean_x"]),
        "r2": F.when(enough, F.try_divide(sums["cov"] * sums["cov"], spread)),
    }
