"""Connected components of links between nodes, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.shared import materialise


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) for each node of ``links`` (columns a, b of one orderable type): the smallest node it reaches.

    Each round joins every node with the smallest of its neighbours; a node with very many neighbours is a skewed
    join side, which adaptive execution splits, and no list of neighbours is ever gathered. Rounds grow with the
    logarithm of the longest path. Each round is a table in the shared folder, so nothing depends on one executor.
    """
    edges = links.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = materialise(edges, "links")
    before = _state(edges)
    if not before[0]:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    for _ in range(most_rounds):
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        # Large star: each larger neighbour of a node moves to the node's smallest.
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = materialise(large, "large-star")
        # Small star: each node and its smaller neighbours move to the smallest of them.
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        edges = materialise(small.where("a <> b").distinct(), "small-star")
        now = _state(edges)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components don't settle within {most_rounds} rounds")
    roots = edges.select(F.col("b").alias("node")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots.select("node", F.col("node").alias("component")))
