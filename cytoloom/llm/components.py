"""Connected components by alternating large-star and small-star steps over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def connected_components(edges: DataFrame, left: str = "u", right: str = "v") -> DataFrame:
    """(node, root) for each node that has an edge to another; root is the smallest node it can reach.

    Each round is two aggregations (with map-side combine) and two equi-joins, which adaptive execution can split where one node
    has very many edges; it ends as soon as all edges are stars, for which one aggregation looks, so no round runs in vain. Only that
    answer reaches the driver. Loops and nulls are ignored, repeated edges count once.
    """
    u, v = F.col(left), F.col(right)
    pairs = edges.where(u != v).select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v")).distinct()
    pairs = materialize(pairs)
    while True:
        # Stars: each node hangs on one other, and what it hangs on hangs on nothing. An edge goes from the larger to the smaller node,
        # so a star's centre is its smallest.
        ends = pairs.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("up")), F.struct(F.col("v").alias("node"), F.lit(0).alias("up")))).alias("e"))
        ends = ends.groupBy("e.node").agg(F.sum("e.up").alias("up"), F.min("e.up").alias("least"))
        if ends.where("up > 1 or up = 1 and least = 0").isEmpty():
            return pairs.select(F.col("u").alias("node"), F.col("v").alias("root"))
        both = pairs.union(pairs.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # Large star: larger neighbours hang on the smallest of the neighbourhood.
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: smaller neighbours and the node itself hang on the smallest neighbour.
        lowest = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lowest, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        pairs = materialize(small.union(lowest.select("u", F.col("m").alias("v"))).distinct())
