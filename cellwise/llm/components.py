"""Connected components over an edge table, by alternating large-star and small-star rounds.

Each round is two grouped minima joined back to the edges, written to the shared folder, so lost
executors cost one round and no link ever reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star operation on edges (u, v)."""
    if large:
        pairs = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        out = pairs.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        pairs = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = pairs.groupBy("u").agg(F.min("v").alias("m"))
        out = pairs.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node that has an edge; the root is the least node reachable.

    ``edges`` has columns u and v of one orderable type; loops and repeated edges are allowed.
    """
    now, before = cut(edges.where("u <> v").select("u", "v").distinct(), "edges"), None
    while True:
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = state
        now = cut(_star(_star(now, True), False), "edges")
