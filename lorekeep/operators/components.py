"""Connected components of an undirected graph by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import release, stored


def contracted(edges: DataFrame, large: bool) -> DataFrame:
    """One step on edges (u > v): the larger neighbours of a node (or the node and its smaller ones) are linked to the least around it."""
    around = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    least = around.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    joined = around.join(least, "u")
    out = joined.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")) if large else joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least)
    return out.filter("u <> v").distinct()


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """node, root (the smallest node reachable) for every end of the edges (a, b), of any type that has an order.

    Loops and repeated edges change nothing, edges with a null end are left out, no edges give no rows. Each round is a
    stored table (called name), that of the round before is deleted. No round gathers a node's neighbours: it aggregates
    their minimum and joins it back, which adaptive execution may split at a hub.
    """
    now = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name)
    size = now.count()
    while size:
        after = stored(contracted(contracted(now, True), False), name)
        left = after.count()
        done = left == size and after.join(now, ["u", "v"], "left_anti").isEmpty()
        release(now)
        now, size = after, left
        if done:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
