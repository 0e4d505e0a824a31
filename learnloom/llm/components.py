"""Connected components by alternating large-star and small-star steps.

Each step is an aggregate (minimum neighbour per node, combined before the shuffle) and a join
with it. Only that join deals a hub's edges by the hub; the runtime's skew split divides them.
The edges of every round are a written table. The joins are sorted shuffles whatever their size: a
broadcast would be built on the driver, and each round would add one that grows with the input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from learnloom.session import Scratch


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    moved = both.where("v > u").join(least.hint("merge"), "u")
    return moved.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least.hint("merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).where("u != v").distinct()


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) of every node of ``edges`` (u, v); the root is the smallest node."""
    edges = scratch.save(
        edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct()
    )
    mark = None
    while True:
        following = scratch.save(_small_star(_large_star(edges)))
        new_mark = following.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()
        scratch.drop(edges)
        edges = following
        if new_mark == mark:
            break
        mark = new_mark
    roots = edges.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("root"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
