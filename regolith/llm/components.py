"""Connected components by alternating star contraction over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import materialize


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b); component is the smallest node.

    Each round links all larger neighbours of a node to its smallest neighbour, then all
    smaller ones; every intermediate is an edge table written to the shared folder, and
    only the count of changed rows reaches the driver.  No edges: no rows.
    """
    cur = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    if not cur.take(1):
        return cur.select(F.col("a").alias("node"), F.col("b").alias("component"))
    for _ in range(rounds):
        both = cur.select(F.col("a").alias("u"), F.col("b").alias("v")).union(cur.select(F.col("b").alias("u"), F.col("a").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        large = large.union(low.where("m < u").select(F.col("u").alias("a"), F.col("m").alias("b"))).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.col("b").alias("x"), "m").where("x <> m")
        small = small.union(least.select(F.col("a").alias("x"), "m")).select(F.col("x").alias("a"), F.col("m").alias("b")).distinct()
        nxt = materialize(small, "edges")
        # a forest of stars: each node points once, and to nodes that point nowhere
        if not nxt.groupBy("a").count().where("count > 1").take(1) and not nxt.join(nxt.select(F.col("a").alias("b")), "b", "left_semi").take(1):
            pairs = nxt
            break
        cur = nxt
    else:
        raise RuntimeError("components did not settle")
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        pairs.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
