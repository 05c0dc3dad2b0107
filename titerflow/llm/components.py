"""Connected components by alternating large-star and small-star steps."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from titerflow.llm.common import written


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node hands its larger neighbours to the smallest node it knows."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node hands its smaller neighbours, and itself, to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    handed = down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    own = low.select("u", F.col("m").alias("v"))
    return handed.unionByName(own).where("u != v").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, component`` (smallest node reachable) for every node of the undirected ``edges (u, v)``.

    Every round is written to the shared folder.  A node's neighbours are never gathered: a round uses only a
    minimum per node (combined before the shuffle) and a join of edges to it.  Ends when a round changes
    nothing; the number of rounds grows with the logarithm of the longest path.  Loops and rows with a null
    are ignored.
    """
    now = written(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = None
    while True:
        now = written(_small_star(_large_star(now)))
        seen = now.agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")
        ).first()
        if seen == mark:
            break
        mark = seen
    root = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return root.unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
