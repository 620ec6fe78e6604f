"""A Merkle manifest of a dataset: one leaf a row, a tree for each language, one tree over the languages.

Where a row stands in its language's tree is read from a bitmap of doc_ids instead of a sorted table. Tasks OR 64-bit words
together; 64 words of one language make a container, which holds the words that are not empty, one more word that tells which
those are, and a directory of how many rows precede each. Containers carry their language's running total, so the position
of a row is three additions and two population counts on the one container of its doc_id.

Positions then key slot arrays: 4,096 consecutive slots meet in one task, which hashes them up to one node. The nodes of
all arrays are the slots of the next round, until an array holds a whole tree. Every array gets the siblings above it back,
and each row's proof is what it meets on the way to the root.

Nulls hash as ``-``; a null doc_id comes first in its language and is never tampered with, a null language is a group of its own
and the first. Rows of one doc_id and language are in order of their leaves; equal rows take one position each. No number of
them meets in one task: rows of the words that hold such ids are counted by content and placed by range. An empty table gives no rows.
Only the named columns are read, whatever others there are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aeroseries.functions.lineage import stage_table
from aeroseries.llm.ranks import running_totals

#: What a leaf covers, in this order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Levels that one slot array reduces.
LEVELS = 12
SLOTS = 1 << LEVELS
#: A container of its own for rows without doc_id, before all others.
_NO_ID = -(1 << 51) - 1

_BLOCK_SCHEMA = (
    "tree string, size long, block long, ids array<long>, digests binary, is_changed array<boolean>, changed binary, node string"
)


def digest(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


# Leaves


def _part(value: Column) -> Column:
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def _leaf(values: dict[str, Column]) -> Column:
    return F.unhex(F.sha2(F.concat(*(_part(values[name]) for name in FIELDS)), 256))


def leaves(df: DataFrame, every: int = 7) -> DataFrame:
    """tree, doc_id, leaf, and the leaf after tampering where ``every`` divides the CRC-32 of the doc_id."""
    values = {name: F.col(name) for name in FIELDS}
    longer = {**values, "n_chars": F.col("n_chars").cast("decimal(20,0)") + 1}
    hit = F.crc32(F.col("doc_id").cast("string")) % every == 0
    tree = F.when(F.col("lang").isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col("lang")))
    return df.select(
        tree.alias("tree"),
        F.col("doc_id").cast("long").alias("doc_id"),
        _leaf(values).alias("leaf"),
        F.when(hit, _leaf(longer)).alias("changed"),
    )


# Bitmaps


def _below(bits: Column, n: Column) -> Column:
    """How many of the lowest ``n`` bits are set."""
    return F.bit_count(bits.bitwiseAND(F.bitwise_not(F.call_function("shiftleft", F.lit(-1).cast("long"), n))))


def _one(n: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), n)


def _placed(df: DataFrame) -> DataFrame:
    """Add the container of the doc_id, its word there and its bit in the word."""
    doc_id = F.col("doc_id")
    low = F.coalesce(doc_id, F.lit(0).cast("long"))
    return df.withColumns(
        {
            "bucket": F.coalesce(F.shiftright(doc_id, 12), F.lit(_NO_ID)),
            "word": F.shiftright(low, 6).bitwiseAND(63).cast("int"),
            "bit": low.bitwiseAND(63).cast("int"),
        }
    )


def containers(ids: DataFrame) -> DataFrame:
    """Bitmaps of (tree, doc_id) with their directories and what precedes them in their tree.

    ``repeats`` tells which words hold an id more than once: their rows are more than their bits.
    """
    words = _placed(ids).groupBy("tree", "bucket", "word").agg(
        F.bit_or(_one(F.col("bit"))).alias("bits"), F.count("*").alias("rows")
    )
    merged = words.groupBy("tree", "bucket").agg(
        F.bit_or(_one(F.col("word"))).alias("summary"),
        F.sort_array(F.collect_list(F.struct("word", "bits", "rows"))).alias("found"),
        F.sum("rows").alias("rows"),
    )
    merged = merged.select(
        "tree",
        "bucket",
        "summary",
        "rows",
        F.expr("transform(found, w -> w.bits)").alias("words"),
        F.expr("transform(found, (w, i) -> aggregate(slice(found, 1, i), 0L, (n, v) -> n + v.rows))").alias("directory"),
        F.expr("transform(found, w -> w.rows <> bit_count(w.bits))").alias("repeats"),
    )
    return running_totals(merged, ["tree"], [F.col("bucket")], "rows", "base")


def positions(leaf_rows: DataFrame, index: DataFrame) -> DataFrame:
    """(tree, position, doc_id, leaf, changed): where each leaf stands in its tree."""
    joined = _placed(leaf_rows).join(index.drop("rows"), ["tree", "bucket"])
    joined = joined.withColumn("at", _below(F.col("summary"), F.col("word")))
    joined = joined.withColumns(
        {"start": F.col("base") + F.get("directory", "at"), "repeated": F.get("repeats", "at"), "bits": F.get("words", "at")}
    )
    single = joined.where("NOT repeated").withColumn("position", F.col("start") + _below(F.col("bits"), F.col("bit")))
    columns = ["tree", "position", "doc_id", "leaf", "changed"]
    if index.where(F.exists("repeats", lambda repeated: repeated)).isEmpty():
        return single.select(columns)
    same = joined.where("repeated").groupBy("tree", "start", "doc_id", "leaf", "changed").agg(F.count("*").alias("copies"))
    order = [F.col("doc_id"), F.col("leaf")]
    ranked = running_totals(same, ["tree", "start"], order, "copies", "before")
    first = F.col("start") + F.col("before")
    several = ranked.withColumn("position", F.explode(F.sequence(first, first + F.col("copies") - 1)))
    return single.select(columns).unionByName(several.select(columns))


# Slot arrays


def climb(nodes: list[str], size: int) -> list[list[str]]:
    """The levels of one slot array, the given one first: up to the root of a tree that it holds whole, else LEVELS more."""
    levels = [nodes]
    while len(levels) <= LEVELS if size > SLOTS else len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([digest(*below[i : i + 2]) for i in range(0, len(below), 2)])
    return levels


def siblings(levels: list[list[str]], slot: int) -> list[str]:
    """What the node in a slot meets on its way up: ``L`` or ``R`` with the sibling on that side, or nothing."""
    steps = []
    for nodes in levels[:-1]:
        other = slot ^ 1
        steps.append(("R" if other > slot else "L") + nodes[other] if other < len(nodes) else "")
        slot >>= 1
    return steps


def fold(node: str, steps: Sequence[str]) -> str:
    """The root that a node and its siblings give."""
    for step in steps:
        node = digest(step[1:], node) if step[:1] == "L" else digest(node, step[1:])
    return node


def _hexes(blob: bytes) -> list[str]:
    text = blob.hex()
    return [text[i : i + 64] for i in range(0, len(text), 64)]


def slot_arrays(slots: DataFrame) -> DataFrame:
    """Slots (tree, size, position, id, digest, changed) as arrays of SLOTS consecutive ones, with the node above each."""

    def pack(key: tuple, slots: pa.Table) -> pa.Table:
        slots = slots.sort_by("position")
        digests, changed = b"".join(slots["digest"].to_pylist()), slots["changed"].to_pylist()
        size = slots["size"][0].as_py()
        row = {
            "tree": key[0].as_py(),
            "size": size,
            "block": key[1].as_py(),
            "ids": slots["id"].to_pylist(),
            "digests": digests,
            "is_changed": [value is not None for value in changed],
            "changed": b"".join(value for value in changed if value is not None),
            "node": climb(_hexes(digests), size)[-1][0],
        }
        schema = pa.schema(
            [
                ("tree", pa.string()), ("size", pa.int64()), ("block", pa.int64()), ("ids", pa.list_(pa.int64())),
                ("digests", pa.binary()), ("is_changed", pa.list_(pa.bool_())), ("changed", pa.binary()), ("node", pa.string()),
            ]
        )
        return pa.Table.from_pylist([row], schema)

    block = F.shiftright("position", LEVELS).alias("block")
    return stage_table(slots.groupBy("tree", block).applyInArrow(pack, _BLOCK_SCHEMA))


def _parents(arrays: DataFrame) -> DataFrame:
    return arrays.select(
        "tree",
        F.shiftright(F.col("size") + SLOTS - 1, LEVELS).alias("size"),
        F.col("block").alias("position"),
        F.col("block").alias("id"),
        F.unhex("node").alias("digest"),
        F.lit(None).cast("binary").alias("changed"),
    )


def _from_each(arrays: DataFrame, above: DataFrame) -> DataFrame:
    """(tree, id, steps, root) of each slot, given the way up from the node above its array."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                levels = climb(_hexes(row["digests"]), row["size"])
                steps = [siblings(levels, slot) + row["steps"] for slot in range(len(row["ids"]))]
                n = len(steps)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["tree"]] * n, pa.string()), pa.array(row["ids"], pa.int64()),
                        pa.array(steps, pa.list_(pa.string())), pa.array([row["root"]] * n, pa.string()),
                    ],
                    names=["tree", "id", "steps", "root"],
                )

    joined = arrays.join(above, ["tree", "block"]).select("tree", "size", "ids", "digests", "steps", "root")
    return joined.mapInArrow(spread, "tree string, id long, steps array<string>, root string")


def ways_up(arrays: DataFrame, largest: int) -> DataFrame:
    """(tree, block, steps, root): from the node above each array to the root of its tree of at most ``largest`` slots."""
    if largest <= SLOTS:
        return arrays.select("tree", "block", F.array().cast("array<string>").alias("steps"), F.col("node").alias("root"))
    above = slot_arrays(_parents(arrays))
    found = _from_each(above, ways_up(above, -(-largest // SLOTS)))
    return stage_table(found.withColumnRenamed("id", "block"))


def _over_trees(roots: DataFrame) -> DataFrame:
    """(tree, top_steps, top): from each tree's root to the root of all, the trees in the order of their names."""
    ranked = stage_table(running_totals(roots.withColumn("one", F.lit(1).cast("long")), [], [F.col("tree")], "one", "position"))
    count = ranked.count()
    arrays = slot_arrays(
        ranked.select(
            F.lit("").alias("tree"),
            F.lit(count).cast("long").alias("size"),
            "position",
            F.col("position").alias("id"),
            F.unhex("root").alias("digest"),
            F.lit(None).cast("binary").alias("changed"),
        )
    )
    tops = _from_each(arrays, ways_up(arrays, count)).select("id", F.col("steps").alias("top_steps"), F.col("root").alias("top"))
    return ranked.join(tops, F.col("position") == F.col("id")).select("tree", "top_steps", "top")


def manifest(df: DataFrame, every: int = 7) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every row."""
    rows = leaves(df, every)
    index = containers(rows.select("tree", "doc_id"))
    sizes = index.groupBy("tree").agg(F.sum("rows").alias("size"))
    slots = positions(rows, index).join(sizes, "tree")
    arrays = slot_arrays(
        slots.select("tree", "size", "position", F.col("doc_id").alias("id"), F.col("leaf").alias("digest"), "changed")
    )
    ways = ways_up(arrays, sizes.agg(F.coalesce(F.max("size"), F.lit(0)).alias("n")).first().n)
    tops = _over_trees(ways.where("block = 0").select("tree", "root"))
    above = ways.join(tops, "tree").select(
        "tree", "block", F.concat("steps", "top_steps").alias("steps"), F.col("root").alias("subroot"), "top"
    )

    def prove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                own, changed = _hexes(row["digests"]), iter(_hexes(row["changed"]))
                levels = climb(own, row["size"])
                proofs, folded = [], []
                for slot, (leaf, is_changed) in enumerate(zip(own, row["is_changed"])):
                    steps = siblings(levels, slot) + row["steps"]
                    proofs.append(digest(*(step[1:] for step in steps)))
                    folded.append(fold(next(changed) if is_changed else leaf, steps))
                n = len(own)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row["ids"], pa.int64()), pa.array(own), pa.array([row["subroot"]] * n), pa.array([row["top"]] * n),
                        pa.array(proofs), pa.array(folded), pa.array([node == row["top"] for node in folded]),
                    ],
                    names=["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"],
                )

    return arrays.drop("node").join(above, ["tree", "block"]).mapInArrow(
        prove,
        "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean",
    )
