"""Connected components of a graph given by its edges, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.scratch import stored


def _towards_minimum(edges: DataFrame, keep_self: bool) -> DataFrame:
    """Each node's partners are tied to the least of them; ``keep_self`` ties the node as well."""
    least = edges.groupBy("u").agg(F.min("v").alias("least")).withColumn("least", F.least("u", "least"))
    tied = edges.join(least, "u").select(F.col("v").alias("u"), F.col("least").alias("v"))
    if keep_self:
        tied = tied.union(least.select("u", F.col("least").alias("v")))
    return tied.filter("u != v").distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """``node``, ``component`` (the least node reachable) of all nodes with an edge in ``edges`` (u, v).

    Alternates large stars (greater partners go to the least one) and small stars (lesser ones do); the number of
    edges never grows, and rounds grow with the logarithm of the nodes. A hub's least partner is an aggregate, and
    the joins on a hub are split by adaptive execution; no partner list is ever gathered. Every round is written to
    the shared folder, so a lost executor costs one round. No edges give no rows; loops and repeated edges are dropped.
    """
    now = stored(edges.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    mark = None
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("least")).withColumn("least", F.least("u", "least"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("least").alias("v")).filter("u != v").distinct()
        now = stored(_towards_minimum(large, keep_self=True), "edges")
        found = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if tuple(found) == mark:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
                now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        mark = tuple(found)
