"""Breadth-first depths over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.runtime import materialise


def depths(edges: DataFrame, seeds: DataFrame, max_depth: int) -> DataFrame:
    """(node, depth): the fewest edges (src, dst) from a seed (node), up to max_depth.

    A round joins the last level only, drops what is known, and is written, so it costs its level and the plan stays one round long.
    """
    known = materialise(seeds.select("node").distinct().select("node", F.lit(0).alias("depth")), "bfs")
    level = known
    for depth in range(1, max_depth + 1):
        found = edges.join(level.select(F.col("node").alias("src")), "src").select(F.col("dst").alias("node")).distinct()
        level = materialise(found.join(known.select("node"), "node", "left_anti").select("node", F.lit(depth).alias("depth")), "bfs")
        if level.isEmpty():
            break
        known = known.unionByName(level)
    return known
