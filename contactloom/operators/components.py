"""Connected components for operators of the core, by contraction along random neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contactloom.runtime import Scratch


def contract(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(vertex, root) for each vertex of the edges (a, b), root being the same for all vertices of a
    component and one of them.

    In a round every vertex is merged into whichever of itself and its neighbours comes first; links
    between merged vertices go on to the next round. In the first two rounds the order is the vertices'
    own, which ends stars around a least vertex at once; after that it is another hash in each round, so
    that a share of the vertices disappears each time and rounds grow with the logarithm of the largest
    component. Nothing but links is ever grouped, and those with partial sums."""
    edges = scratch.write(edges.select("a", "b").filter("a <> b").distinct())
    steps: list[DataFrame] = []
    while not edges.isEmpty():
        turn = F.lit(len(steps) + 1) if len(steps) >= 2 else None
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = lambda c: F.struct((F.xxhash64(F.col(c), turn) if turn is not None else F.lit(0)).alias("h"), F.col(c).alias("v"))
        least = both.groupBy("a").agg(F.min(rank("b")).alias("m"))
        step = scratch.write(least.select(F.col("a").alias("vertex"), F.least(rank("a"), F.col("m"))["v"].alias("into")))
        steps.append(step)
        to = lambda c: step.select(F.col("vertex").alias(c), F.col("into").alias(f"{c}_into"))
        moved = edges.join(to("a"), "a").join(to("b"), "b").select(F.col("a_into").alias("a"), F.col("b_into").alias("b"))
        pair = moved.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        following = scratch.write(pair.filter("a <> b").distinct())
        scratch.drop(edges)
        edges = following
    if not steps:
        return edges.select(F.col("a").alias("vertex"), F.col("b").alias("root"))
    out = steps[0].withColumnRenamed("into", "root")
    for step in steps[1:]:
        next_ = step.select(F.col("vertex").alias("root"), "into")
        out = out.join(next_, "root", "left").select("vertex", F.coalesce("into", "root").alias("root"))
    return out
