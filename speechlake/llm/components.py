"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from speechlake.llm.common import discard, settle


def _lowest(edges: DataFrame) -> DataFrame:
    """Smallest neighbour of each ``u``, itself included.  Settled, so that a hot vertex can be split in the join."""
    return settle(edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "lowest")


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, component): the smallest node that can be reached over ``edges``, for each node that has an edge.

    Nodes are integers.  Every step is a group-by minimum, combined before its shuffle, and a join in which Spark can split
    a hot vertex; the edges are settled after each, tables that nothing reads any more are deleted, and only the edges' count
    and a sum reach the driver.
    Null ends and loops are dropped; no edges give an empty result.
    """
    now = settle(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct(), "edges")
    seen = None
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = _lowest(both)
        joined = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = settle(joined.where("u <> v"), "large")
        discard(now, low)
        low = _lowest(large)
        kept = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        now = settle(kept.where("u <> v").distinct(), "small")
        discard(large, low)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())
        seen = state
