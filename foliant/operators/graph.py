"""Bounded traversal of edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.tables import cut


def distances(edges: DataFrame, start: DataFrame, depth: int) -> DataFrame:
    """(node, hops): the nodes within `depth` edges of `start` (node), with the fewest hops. edges: (src, dst), directed.

    One join a level; a level's nodes are written to the checkpoint folder, so the plan doesn't grow.
    """
    seen = cut(start.select("node").distinct().withColumn("hops", F.lit(0)))
    front = seen
    for hop in range(1, depth + 1):
        step = edges.join(front.select(F.col("node").alias("src")), "src").select(F.col("dst").alias("node")).distinct().join(seen.select("node"), "node", "left_anti")
        front = cut(step.withColumn("hops", F.lit(hop)))
        seen = seen.union(front)
        if front.isEmpty():
            break
    return seen
