"""Connected components of an undirected graph given as pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.common import cut


def connected_components(pairs: DataFrame, a: str, b: str, max_rounds: int = 50) -> DataFrame:
    """``(node, component)``: the smallest node each node is linked to, directly or not.

    Each round hangs every neighbour of a node, and the node itself, below the
    smallest of them, first among the larger neighbours and then among the
    smaller ones; the graph becomes a set of stars in a number of rounds that
    grows with the logarithm of its size. Only pairs are shuffled, minima combine
    before the shuffle, and each round's result is stored in the shared folder.
    Null ends are dropped; a node linked only to itself is its own component.
    """
    start = pairs.select(F.col(a).alias("u"), F.col(b).alias("v")).dropna()
    alone = start.select(F.explode(F.array("u", "v")).alias("node")).distinct()
    edges = cut(start.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    if edges.isEmpty():
        return alone.withColumn("component", F.col("node"))
    for _ in range(max_rounds):
        both = edges.union(edges.select(F.col("v"), F.col("u")).toDF("u", "v"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        lower = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = lower.groupBy("u").agg(F.min("v").alias("m"))
        small = lower.join(least, "u")
        hung = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        following = cut(hung.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct())
        changed = not following.exceptAll(edges).isEmpty() or not edges.exceptAll(following).isEmpty()
        edges = following
        if not changed:
            break
    else:
        raise RuntimeError(f"not settled after {max_rounds} rounds")
    return alone.join(edges.select(F.col("u").alias("node"), F.col("v").alias("component")), "node", "left").select("node", F.coalesce("component", "node").alias("component"))
