"""Connected components of a graph held in a DataFrame.

Large-star and small-star rounds (each node's neighbours are tied to the smallest among them) until nothing changes. Each
round is two aggregations and joins over edges; a hub's edges are summed where they lie before they are shuffled, and
joins on a hub can be split by Spark, as their other side has one row for each node. Rounds are written to the shared
folder, so a lost executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, release


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(``node``, ``component``): the smallest node that each node of ``edges`` reaches, for all nodes but those smallest.

    Nodes are longs; nulls and loops link nothing. The smallest node of a component has no row, nor has one without
    edges: both are their own. The number of rounds grows
    with the logarithm of a component's extent.
    """
    pairs = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a <> b")
    now = durable(pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    if now.isEmpty():
        return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    before = None
    while True:
        # Large star: every larger neighbour of a node is tied to the node's smallest.
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        large = now.select(F.col("b").alias("a"), F.col("a").alias("other")).join(low, "a").select(F.col("other").alias("a"), F.col("low").alias("b"))
        # Small star: a node and its smaller neighbours are tied to the smallest of them.
        large = durable(large.where("a <> b").distinct(), "large")
        low = large.groupBy("a").agg(F.min("b").alias("low"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("a"), F.col("low").alias("b")), F.struct(F.col("b").alias("a"), F.col("low").alias("b")))).alias("e"))
        new = durable(small.select("e.a", "e.b").where("a <> b").distinct(), "edges")
        release(large, now)
        # Settled when each node has one edge, and that to a node that has none.
        state = new.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        now = new
        if (state["n"], state["s"]) == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component"))
        before = (state["n"], state["s"])
