"""Connected components of a table of links, by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, stored


def connected_components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``links`` (u, v) of any orderable type -> (node, root), root the smallest node reachable.

    Only nodes that stand in a link to another node are returned. A large-star round links the
    larger neighbours of each node to the smallest node of its neighbourhood, a small-star round its
    smaller neighbours; links become stars around the roots in a number of rounds of the order of
    log squared of the largest component. Neighbourhoods are joined to their minimum, never
    gathered, so a node with very many links stays spread over tasks. Every round is stored.
    Null ends and links of a node to itself are ignored; repeated links count once.
    """
    edges = links.where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    edges = stored(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = None
    for _ in range(most_rounds):
        now = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")).first()
        if now == state or not now["n"]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        state = now
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("x"), F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, F.col("u") == F.col("x")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Every link now points from the larger to the smaller node.
        low = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("x"), "m")
        joined = large.join(low, F.col("u") == F.col("x")).select("u", "v", "m")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select(F.col("x").alias("u"), F.col("m").alias("v")))
        last, edges = edges, stored(small.distinct())
        release(edges.sparkSession, last)
    raise RuntimeError(f"components still change after {most_rounds} rounds")
