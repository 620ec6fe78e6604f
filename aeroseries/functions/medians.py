"""Exact medians: of bounded arrays, and of groups too large to gather."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aeroseries.functions.lineage import cut_lineage


def middle(ordered: str) -> str:
    """SQL for the median of a sorted array without nulls; null when it is empty.

    The array is looked at several times, so it should be named, not computed in place.
    """
    return f"(get({ordered}, int((size({ordered}) - 1) div 2)) + get({ordered}, int(size({ordered}) div 2))) / 2"


def _magnitude(value: Column) -> Column:
    """Signed decimal exponent, increasing with the value."""
    exponent = F.least(F.greatest(F.floor(F.log10(F.abs(value))), F.lit(-290)), F.lit(308))
    return F.when(value == 0, F.lit(0)).otherwise(F.signum(value).cast("int") * (exponent + 400).cast("int"))


def _leading_digits(value: Column, magnitude: Column, digits: int) -> Column:
    """The first significant digits as an integer, increasing with the value inside one magnitude."""
    exponent = F.abs(magnitude) - 400
    return F.when(value == 0, F.lit(0)).otherwise(F.floor(value * F.pow(F.lit(10.0), digits - 1 - exponent)))


def exact_median(
    df: DataFrame, keys: Sequence[str], value: str, name: str = "median", broadcast_picks: bool = False
) -> DataFrame:
    """Median of ``value`` per key, one row per key, whatever the size of a group.

    Values are counted by their leading digits first. Counting combines on the map side and spreads one group
    over all tasks. Only the bucket or two that hold the middle ranks are looked at again, with more digits,
    until distinct values are left. Every ordered step sees at most one row per bucket: 9,000 for each power of
    ten, then a million, then the few million doubles that share ten digits, never the rows of a group.

    Runs at once and keeps its result in the checkpoint folder, so that callers can use it more than once.
    """
    keys = list(keys)
    rows = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("_v"))
    rows = rows.withColumn("_m", _magnitude(F.col("_v")))

    def digits(frame: DataFrame, n: int) -> DataFrame:
        return frame.withColumn("_d", _leading_digits(F.col("_v"), F.col("_m"), n))

    def middle_of(counts: DataFrame, order: Sequence[str], ranked: bool) -> DataFrame:
        """Keep the buckets covering ranks ``_lo`` and ``_hi``, and restate both ranks inside them."""
        ordered = Window.partitionBy(*keys).orderBy(*order)
        whole = Window.partitionBy(*keys)
        counts = counts.withColumn("_upto", F.sum("_c").over(ordered))
        if not ranked:
            total = F.sum("_c").over(whole)
            counts = counts.withColumn("_lo", F.floor((total + 1) / 2)).withColumn("_hi", F.floor(total / 2) + 1)
        counts = counts.where((F.col("_upto") >= F.col("_lo")) & (F.col("_upto") - F.col("_c") < F.col("_hi")))
        skipped = F.min(F.col("_upto") - F.col("_c")).over(whole)
        return counts.select(
            *keys, *order, (F.col("_lo") - skipped).alias("_lo"), (F.col("_hi") - skipped).alias("_hi")
        )

    def narrowed(frame: DataFrame, picks: DataFrame) -> DataFrame:
        picks = F.broadcast(picks) if broadcast_picks else picks
        return frame.join(picks, [*keys, "_m", "_d"])

    coarse = digits(rows, 4)
    picks = middle_of(coarse.groupBy(*keys, "_m", "_d").agg(F.count("*").alias("_c")), ["_m", "_d"], False)
    left = cut_lineage(
        narrowed(coarse, picks).groupBy(*keys, "_m", "_v", "_lo", "_hi").agg(F.count("*").alias("_c"))
    )
    fine = digits(left, 10)
    picks = middle_of(
        fine.groupBy(*keys, "_m", "_d", "_lo", "_hi").agg(F.sum("_c").alias("_c")), ["_m", "_d"], True
    )
    left = narrowed(fine.drop("_lo", "_hi"), picks)
    last = middle_of(left.select(*keys, "_v", "_c", "_lo", "_hi"), ["_v"], True)
    return cut_lineage(last.groupBy(*keys).agg(((F.min("_v") + F.max("_v")) / 2).alias(name)))


#: Ranks of the sketch that brackets a median are off by one in this many rows at most.
SKETCH_ACCURACY = 10_000


def bracketed_medians(
    df: DataFrame,
    keys: Sequence[str],
    values: Mapping[str, str],
    label: str,
    name: str,
    broadcast_keys: bool = False,
    accuracy: int = SKETCH_ACCURACY,
    margin: float = 2 / SKETCH_ACCURACY,
) -> DataFrame:
    """Medians of several SQL values per key in two scans: (keys, ``label``, ``name``, ``rows``, ``n``), one row per key and value.

    A quantile sketch of each value names two readings that the median lies between. The second scan counts what is below them and
    every distinct value in between, a few in ten thousand, so ranks and result are exact and no group meets in one task.
    Where the middle ranks turn out to lie outside the bracket, :func:`exact_median` takes the key's rows instead.
    """
    keys = list(keys)
    sums = ["count(*) AS rows"]
    for item, value in values.items():
        sums.append(f"count({value}) AS n_{item}")
        sums.append(f"percentile_approx({value}, array({0.5 - margin}D, {0.5 + margin}D), {accuracy}) AS b_{item}")
    sketch = cut_lineage(df.groupBy(*keys).agg(*(F.expr(e) for e in sums)))
    near = F.broadcast(sketch) if broadcast_keys else sketch
    # Values below the bracket are one group, those above are left out.
    marked = ", ".join(
        f"named_struct('{label}', '{item}', '_v', CASE WHEN {value} < b_{item}[0] THEN double('-Infinity')"
        f" WHEN {value} <= b_{item}[1] THEN double({value}) END)"
        for item, value in values.items()
    )
    counted = df.join(near, keys).selectExpr(*keys, f"inline(array({marked}))").where("_v IS NOT NULL")
    counted = counted.groupBy(*keys, label, "_v").agg(F.count("*").alias("_c"))
    rows = ", ".join(f"named_struct('{label}', '{i}', 'n', n_{i}, '_low', b_{i}[0])" for i in values)
    sizes = sketch.selectExpr(*keys, "rows", f"inline(array({rows}))")
    ordered = Window.partitionBy(*keys, label).orderBy("_v")
    ranked = counted.join(sizes.drop("rows"), [*keys, label]).withColumn("_upto", F.sum("_c").over(ordered))
    first, last = F.floor((F.col("n") + 1) / 2), F.floor(F.col("n") / 2) + 1
    ranked = ranked.where((F.col("_upto") >= first) & (F.col("_upto") - F.col("_c") < last))
    middle_values = ranked.groupBy(*keys, label).agg(
        ((F.min("_v") + F.max("_v")) / 2).alias(name),
        # Both ranks must be covered, and not by the values below the bracket.
        ((F.max("_upto") >= F.max(last)) & (F.min("_v") >= F.max("_low"))).alias("_sure"),
    )
    found = cut_lineage(sizes.drop("_low").join(middle_values, [*keys, label], "left"))
    unsure = found.where("n > 0 AND NOT coalesce(_sure, FALSE)").select(*keys, label)
    found = found.drop("_sure")
    if unsure.isEmpty():
        return found
    each = ", ".join(f"named_struct('{label}', '{item}', '_value', {value})" for item, value in values.items())
    again = df.selectExpr(*keys, f"inline(array({each}))").join(unsure, [*keys, label], "left_semi")
    exact = exact_median(again, [*keys, label], "_value", "_exact", broadcast_keys)
    found = found.join(exact, [*keys, label], "left")
    return found.withColumn(name, F.coalesce("_exact", name)).drop("_exact")
