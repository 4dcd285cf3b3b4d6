"""Connected components of an edge table by alternating star contraction, with one written table per round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Hang the larger (or the smaller and equal) neighbours of every node on its smallest neighbour."""
    if large:
        pairs = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        pairs = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    hung = pairs.join(least, "u")
    hung = hung.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")) if large else hung.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return hung.where(F.col("u") != F.col("v")).distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether every node hangs on one node that hangs on none, so that another round would change nothing."""
    nodes = edges.select(F.col("u").alias("node"), F.lit(1).alias("hung")).union(edges.select(F.col("v").alias("node"), F.lit(0).alias("hung")))
    return nodes.groupBy("node").agg(F.sum("hung").alias("n"), F.min("hung").alias("least")).where("n > 1 or n = 1 and least = 0").isEmpty()


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable over ``edges`` (u, v).  Nodes without an edge have no row.

    Each round joins edges with the smallest neighbour of a node (a grouped minimum, combined before
    the shuffle) and writes the new edges; it ends when they are stars around smallest nodes.
    """
    now = stored(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    for _ in range(most_rounds):
        if _settled(now):
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        now = stored(_star(_star(now, large=True), large=False), "edges")
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
