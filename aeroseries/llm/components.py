"""Connected components of a table of links, as rounds of joins over checkpointed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aeroseries.functions.lineage import cut_lineage


def connected_components(links: DataFrame) -> DataFrame:
    """Rows (node, component) for all nodes of ``links`` (a, b); the component is the smallest node.

    Alternates two steps until no link changes: every node sends its larger neighbours to the smallest node it knows,
    then its smaller ones. Each round at least halves the height of the trees, so few rounds suffice; a node with very
    many neighbours is aggregated before the shuffle, since only its smallest neighbour is gathered.
    """
    edges = links.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = cut_lineage(edges)
    while True:
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        # Large step: neighbours larger than the node move to the smallest node known.
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = cut_lineage(large.filter("a <> b").distinct())
        # Small step: the node and its smaller neighbours move to the smallest of them.
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        small = cut_lineage(small.union(low.select("a", F.col("m").alias("b"))).distinct())
        changed = small.exceptAll(edges).limit(1).count() + edges.exceptAll(small).limit(1).count()
        edges = small
        if not changed:
            break
    roots = edges.select(F.col("b").alias("node")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        roots.select("node", F.col("node").alias("component"))
    )
