"""Connected components by alternating large-star and small-star rounds, on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b (of one type, no nulls). Returns node, component (the smallest node that it reaches), for nodes with an edge.

    Each round only sends minima along edges, so a hub's neighbours are combined before the shuffle, and is written to
    the shared folder, which cuts the lineage.
    """
    now = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct(), "edges")
    if now.limit(1).count() == 0:
        return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    for _ in range(ROUNDS):
        ends = now.select(F.col("u").alias("x"), F.lit(1).alias("down")).union(now.select("v", F.lit(0)))
        roles = ends.groupBy("x").agg(F.sum("down").alias("a"), F.sum(1 - F.col("down")).alias("b"))
        if not roles.where("a > 1 OR (a = 1 AND b > 0)").limit(1).count():  # every tree is a star around its least node
            break
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u > v").distinct()
        floor = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(floor, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(floor.select("u", F.col("m").alias("v")))
        now = written(small.where("u > v").distinct(), "edges")
    else:
        raise RuntimeError(f"no stars after {ROUNDS} rounds")
    nodes = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.union(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
