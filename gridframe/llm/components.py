"""Connected components of an edge table by alternating large and small stars.

Every step is an aggregation with partial sums and a join, so a hub with very
many neighbours is split by Spark's skew join; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridframe.llm import text as T


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.hash("u", "v").cast("decimal(20,0)"))).first())


def _both(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _star(pairs: DataFrame, large: bool) -> DataFrame:
    """Link the larger (large star) or the smaller (small star) neighbours of every
    node u to the least node around u; ``pairs`` has (u, v)."""
    near = pairs if large else pairs.where("v < u")
    low = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = near.join(low, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the least node of each node's component, for all nodes of
    ``edges(u, v)``. Loops and nulls are left out; an empty table gives no rows."""
    now = T.reliable(edges.select("u", "v").where("u <> v").select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = _state(now)
    while True:
        now = T.reliable(_star(_star(_both(now), large=True), large=False))
        after = _state(now)
        if after == state:
            break
        state = after
    stars = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.union(stars.select(F.col("component").alias("node"), "component").distinct())
