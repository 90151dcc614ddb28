"""Connected components by alternating large-star and small-star steps.

Every step is a join and an aggregate over the edge table, so no component is
ever gathered in one task; each step's edges are written to the shared folder,
which cuts the lineage and survives lost executors, and the step's before are
deleted. The steps needed grow with the logarithm of a component's longest path;
after ``MAX_STEPS``, far beyond any path that could be stored, a RuntimeError says
so rather than a wrong result. Nodes without edges don't appear. An empty edge
table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import common

MAX_STEPS = 60


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """From links (u, v) of longs: one row (node, root) per linked node, root its component's smallest node."""
    now = common.written(edges.select("u", "v").where("u <> v").distinct(), "edges")
    state = None
    for _ in range(MAX_STEPS):
        now, old = common.written(_small_star(_large_star(now)), "edges"), now
        common.discard(old)
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(seen) == state:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
        state = tuple(seen)
    raise RuntimeError(f"components did not settle in {MAX_STEPS} steps")
