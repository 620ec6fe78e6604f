"""The manifest against trees built from sorted lists, on edges and with several rounds of slot arrays."""

from __future__ import annotations

import hashlib
import zlib
from collections import Counter

import pytest
from pyspark.sql import types as T

from aeroseries.llm import merkle

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("source", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        T.StructField("text", T.StringType()),
        # Names that the operator might use for itself.
        *(T.StructField(name, T.StringType()) for name in ("tree", "leaf", "position", "Bucket", "word", "steps", "root")),
    ]
)


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_levels(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + 2]) for i in range(0, len(levels[-1]), 2)])
    return levels


def way(levels, i):
    out = []
    for nodes in levels[:-1]:
        out.append((i % 2, nodes[i ^ 1] if i ^ 1 < len(nodes) else ""))
        i //= 2
    return out


def plain_leaf(row):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def plain_manifest(rows):
    trees = {}
    for row in rows:
        trees.setdefault(row[2], []).append(row)
    names = sorted(trees, key=lambda lang: (lang is not None, (lang or "").encode()))
    for own in trees.values():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(r)))
    levels = {lang: plain_levels([plain_leaf(r) for r in trees[lang]]) for lang in names}
    top = plain_levels([levels[lang][-1][0] for lang in names])
    out = Counter()
    for k, lang in enumerate(names):
        for i, row in enumerate(trees[lang]):
            steps = way(levels[lang], i) + way(top, k)
            doc_id, source, _, n_chars, text = row
            hit = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 0 and n_chars is not None
            node = plain_leaf((doc_id, source, lang, n_chars + 1, text) if hit else row)
            for odd, sibling in steps:
                node = h(sibling, node) if odd else h(node, sibling)
            root = top[-1][0]
            out[doc_id, plain_leaf(row), levels[lang][-1][0], root, h(*(s for _, s in steps)), node, node == root] += 1
    return out


def found(spark, rows):
    df = merkle.manifest(spark.createDataFrame([(*row, *["x"] * 7) for row in rows], SCHEMA).repartition(5))
    return Counter(tuple(row) for row in df.collect())


EDGES = [
    (None, None, None, None, None),
    (None, "s", "en", 3, "abc"),
    (None, "s", "en", 3, "abd"),
    (0, "s", "", 1, "é"),
    (-1, "s", "en", None, ""),
    (-(2**63), "s", "en", 2**63 - 1, "long " * 50_000),
    (2**63 - 1, "s", "en", 0, "x"),
    (64, None, "zß", 5, "one"),
    *[(5, "s", "en", 2**63 - 1, "same row")] * 5,
    (5, "s", "en", 7, "same id"),
    (5, "s", "en", 8, "same id"),
    (4, "s", "en", 8, "beside"),
    (6, "s", "en", 8, "beside"),
]


def test_manifest_on_edges(spark):
    assert found(spark, EDGES) == plain_manifest(EDGES)


@pytest.mark.parametrize("rows", [[(3, "s", "en", 1, "a")], [(3, "s", "en", 1, "a"), (4, "s", None, 1, "a")]])
def test_lone_leaves(spark, rows):
    assert found(spark, rows) == plain_manifest(rows)


def test_several_rounds(spark):
    rows = [(i * 37 % 9973 - 50 * (i % 11), "s", "de", i, f"text {i}") for i in range(9_000)]
    rows += [(i, "s", f"l{i}", i, "own language") for i in range(40)]
    assert found(spark, rows) == plain_manifest(rows)


def test_many_trees(spark):
    rows = [(i, "s", f"l{i % 5000}", i, "x") for i in range(6_000)]
    assert found(spark, rows) == plain_manifest(rows)


def test_empty_table(spark):
    assert not found(spark, [])


def test_an_array_that_is_part_of_a_tree_has_all_levels():
    lone = merkle.climb([h("a")], merkle.SLOTS + 1)
    assert [len(nodes) for nodes in lone] == [1] * (merkle.LEVELS + 1)
    assert merkle.climb([h("a")], 1) == [[h("a")]]
    steps = merkle.siblings(lone, 0)
    assert merkle.fold(h("a"), steps) == lone[-1][0]
