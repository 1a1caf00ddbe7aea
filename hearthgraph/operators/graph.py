"""Connected components of a table of links, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearthgraph.sources.snapshots import stored


def _star(edges: DataFrame, larger: bool) -> DataFrame:
    """For each node u with smallest neighbour m (u itself included): link m to the neighbours of
    u that are larger than u, or to those that are not (and u)."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if larger else edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    joined = both.join(least, "a")
    if larger:
        out = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        out = joined.select(F.explode(F.array("a", "b")).alias("a"), F.col("m").alias("b"))
    return out.where(F.col("a") != F.col("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) -> (node, root): every node of an edge with the smallest node it reaches.

    Loops and repeated edges do no harm; nodes without an edge are not in the result. Each round
    is written to the shared folder, so a lost executor costs at most that round; rounds grow
    with the logarithm of a component's width."""
    edges = stored(edges.where(F.col("a") != F.col("b")).distinct(), "edges")
    seen = None
    while True:
        edges = stored(_star(_star(edges, True), False), "edges")
        now = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x"), F.countDistinct("a").alias("nodes")).first()
        if now.n == now.nodes and (now.n, now.x) == seen:
            break
        seen = (now.n, now.x)
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots)
