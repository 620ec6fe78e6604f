"""Placing rows on shards through a permutation-filled lookup table.

Shards take turns in claiming slots of a table of prime size, each in the order of its own permutation, until all slots
are taken. A row's key is hashed to a slot, and the slot names the shard. Adding or removing a shard moves few slots.

The table has ``table_size`` entries whatever the data, so it is broadcast; rows are neither shuffled nor sorted.

Defined cases: a null key is placed like an empty one; equal keys share a shard; an empty table gives no rows; a column
that is already called ``shard`` or ``slot`` is replaced; other columns are kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Slots of the table: a prime, and over a hundred for each shard, so that shares differ by less than one in a hundred.
TABLE_SIZE = 2039
#: The largest table that is broadcast.
MAX_TABLE_SIZE = 655_373


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:8], 16)


def lookup_table(shards: Sequence[str], table_size: int = TABLE_SIZE) -> list[int]:
    """The number of the shard that holds each slot."""
    if not 0 < len(shards) <= table_size <= MAX_TABLE_SIZE:
        raise ValueError(f"{len(shards)} shards in {table_size} slots; the most are {MAX_TABLE_SIZE}")
    if any(table_size % k == 0 for k in range(2, int(table_size**0.5) + 1)):
        raise ValueError(f"{table_size} is not a prime")
    at = [_number(f"{name}/offset") % table_size for name in shards]
    skip = [_number(f"{name}/skip") % (table_size - 1) + 1 for name in shards]
    table = [-1] * table_size
    for claim in range(table_size):
        turn = claim % len(shards)
        while table[at[turn]] >= 0:
            at[turn] = (at[turn] + skip[turn]) % table_size
        table[at[turn]] = turn
    return table


def table_frame(spark: SparkSession, shards: Sequence[str], table_size: int = TABLE_SIZE) -> DataFrame:
    """The lookup table as rows (slot, shard)."""
    entries = ",".join(map(str, lookup_table(shards, table_size)))
    placed = spark.range(1).select(F.posexplode(F.split(F.lit(entries), ",")).alias("slot", "shard"))
    return placed.select("slot", F.col("shard").cast("int"))


def slot(key: str, table_size: int):
    """The slot of a key: the leading 60 bits of its MD5, modulo the table's size."""
    digest = F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary"))
    return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint"), F.lit(table_size)).cast("int")


def place(df: DataFrame, key: str, shards: Sequence[str], table_size: int = TABLE_SIZE) -> DataFrame:
    """The rows with their ``slot`` and ``shard`` (a number from 0); columns of these very names are replaced."""
    names = [name for name in df.columns if name not in ("slot", "shard")]
    keyed = df.select(*(F.col(f"`{name}`") for name in names), slot(key, table_size).alias("__slot"))
    table = table_frame(df.sparkSession, shards, table_size).toDF("__at", "__shard")
    joined = keyed.join(F.broadcast(table), F.col("__slot") == F.col("__at"))
    own = (F.col(f"`{name}`") for name in names)
    return joined.select(*own, F.col("__slot").alias("slot"), F.col("__shard").alias("shard"))


def write_shards(df: DataFrame, key: str, shards: Sequence[str], path: str, table_size: int = TABLE_SIZE) -> None:
    """Write one folder per shard; the rows of a shard are spread over tasks by Spark's rebalancing."""
    place(df, key, shards, table_size).hint("rebalance", "shard").write.partitionBy("shard").parquet(path)
