"""Running totals over a table of any size: range partitions, their totals, and a sum inside each."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aeroseries.functions.lineage import stage_table


def running_totals(df: DataFrame, group: Sequence[str], order: Sequence[Column], weight: str, name: str) -> DataFrame:
    """Add ``name``: the sum of ``weight`` over the rows of the group that come earlier in the order.

    Rows are dealt to range partitions, so that a group of any size spreads over many tasks; each row's partition is
    stored with it, since ranges are found by sampling. The totals have one row per partition and group. Rows that are
    equal in the whole order stay in one partition: callers count such rows beforehand and give the count as weight.
    """
    group = list(group)
    spread = df.repartitionByRange(*group, *order).withColumn("_part", F.spark_partition_id())
    spread = stage_table(spread)
    totals = spread.groupBy("_part", *group).agg(F.sum(weight).alias("_total"))
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("_offset", F.coalesce(F.sum("_total").over(earlier), F.lit(0)))
    inside = Window.partitionBy("_part", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    spread = spread.withColumn(name, F.coalesce(F.sum(weight).over(inside), F.lit(0)))
    named = {c: f"_{i}" for i, c in enumerate(["_part", *group])}
    totals = totals.select(*(F.col(c).alias(to) for c, to in named.items()), "_offset")
    same = reduce(and_, (F.col(c).eqNullSafe(F.col(to)) for c, to in named.items()))
    return spread.join(totals, same).withColumn(name, F.col(name) + F.col("_offset")).select(*df.columns, name)
