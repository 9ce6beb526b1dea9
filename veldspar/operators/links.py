"""Closure over links."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import stored


def reachable(edges: DataFrame, seeds: DataFrame, most_hops: int = 1000) -> DataFrame:
    """(node, hops): what is reached from the nodes ``seeds`` (node) over edges (source, target), by the fewest links.

    Each round follows the links of what the last one found, leaves out what is known, and writes only the new nodes, so
    circles end and the work is one join of each edge. Links to one node are combined before they are compared.
    """
    ways = stored(edges.where("source is not null and target is not null and source <> target").select("source", "target").distinct())
    front = stored(seeds.where("node is not null").select("node").distinct().withColumn("hops", F.lit(0)))
    known = [front]
    for hops in range(1, most_hops + 1):
        found = front.join(ways, front["node"] == ways["source"]).select(F.col("target").alias("node")).distinct()
        front = stored(found.join(reduce(DataFrame.union, known).select("node"), "node", "left_anti").withColumn("hops", F.lit(hops)))
        if front.isEmpty():
            return reduce(DataFrame.union, known)
        known.append(front)
    raise RuntimeError(f"there are ways of more than {most_hops} links")
