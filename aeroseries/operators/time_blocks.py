"""Ordered steps along a series of hours that may be too long for one task.

The axis is cut into stretches of the calendar. Each stretch is counted by itself; a small table of their totals gives every
stretch what lies before it. Frames of rows reach over the edge of a block, so rows near an edge go to both sides.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Hours of the calendar in a stretch, and present hours in a block.
STRETCH_HOURS = 4_096
BLOCK_ROWS = 4_096


def running_count(df: DataFrame, keys: Sequence[str], time: str, counted: Column, name: str) -> DataFrame:
    """Add how many rows up to and with each one are counted, per key in time order."""
    keys = list(keys)
    since = F.timestamp_diff("HOUR", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(time))
    placed = df.withColumns({"_stretch": F.floor(since / STRETCH_HOURS), "_one": counted.cast("long")})
    totals = placed.groupBy(*keys, "_stretch").agg(F.sum("_one").alias("_total"))
    earlier = Window.partitionBy(*keys).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("_before", F.coalesce(F.sum("_total").over(earlier), F.lit(0))).drop("_total")
    inside = Window.partitionBy(*keys, "_stretch").orderBy(time).rowsBetween(Window.unboundedPreceding, 0)
    placed = placed.withColumn(name, F.sum("_one").over(inside)).join(totals, [*keys, "_stretch"])
    return placed.withColumn(name, F.col(name) + F.col("_before")).select(*df.columns, name)


def over_blocks(df: DataFrame, keys: Sequence[str], position: str, before: int, after: int, columns: dict[str, str]) -> DataFrame:
    """Add SQL aggregates over a frame of ``before`` rows to ``after`` rows around each, per key by position from 1 on.

    In ``columns`` ``FRAME`` stands for the window.
    """
    keys = list(keys)
    # A row lies in the frames of the rows up to ``after`` before it and up to ``before`` after it.
    first, last = (f"floor(({position} + {shift}) / {BLOCK_ROWS})" for shift in (-after, before))
    spread = df.withColumn("_block", F.explode(F.expr(f"sequence({first}, {last})")))
    frame = f"(PARTITION BY {', '.join([*keys, '_block'])} ORDER BY {position} ROWS BETWEEN {before} PRECEDING AND {after} FOLLOWING)"
    framed = spread.selectExpr("*", *(f"{sql.replace('FRAME', frame)} AS {name}" for name, sql in columns.items()))
    return framed.where(f"_block = floor({position} / {BLOCK_ROWS})").drop("_block")
