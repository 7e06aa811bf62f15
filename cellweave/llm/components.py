"""Connected components of an edge table, by alternating star contractions.

Each round rewires every node to the smallest neighbour it knows, so paths shrink geometrically. Rounds are joins and
aggregates; each is cut by a table in the shared folder, so a lost executor costs one round at most. The heavy centre
of a star is one row on the aggregated side of the join; its edges lie on the other side, which adaptive execution
splits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellweave.session import cut


def _large(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node moves to the node's smallest one."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = edges.groupBy(F.col("a").alias("k")).agg(F.min("b").alias("m")).union(
        edges.groupBy(F.col("b").alias("k")).agg(F.min("a").alias("m"))).groupBy("k").agg(F.min("m").alias("m"))
    moved = both.filter("b > a").join(least, F.col("a") == F.col("k")).select(
        F.col("b"), F.least("m", "a").alias("a"))
    return moved.distinct()


def _small(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, move to the smallest one."""
    least = edges.groupBy(F.col("b").alias("k")).agg(F.min("a").alias("m"))
    moved = edges.join(least, F.col("b") == F.col("k"))
    up = moved.filter("a > m").select(F.col("a").alias("b"), F.col("m").alias("a"))
    return up.union(least.select(F.col("k").alias("b"), F.col("m").alias("a"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """``edges(a long, b long)`` -> ``(node, component)``, the smallest node reachable, for every node of an edge.

    Nulls and loops are no edges; order and repetition of edges don't matter. An empty table gives an empty one.
    """
    state = cut(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct())
    before = None
    while True:
        state = cut(_small(_large(state).select("a", "b")).select("a", "b"))
        now = state.agg(F.count("*"), *[F.sum(F.xxhash64("a", "b", F.lit(k)) % (1 << 31)) for k in (0, 1)]).first()
        if now == before:
            break
        before = now
    tops = state.select(F.col("a").alias("node")).distinct()
    return state.select(F.col("b").alias("node"), F.col("a").alias("component")).union(
        tops.select("node", F.col("node").alias("component")))
