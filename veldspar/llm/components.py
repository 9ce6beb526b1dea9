"""Connected components of edge tables: by alternating large and small stars, or in one task for few edges."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import durable, scope


#: Up to so many distinct edges (32 MB) of 64-bit nodes, a single task takes fewer seconds than the rounds' shuffles.
LOCAL_EDGES = 2_000_000


def labelled(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, least node of their component)."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while len(x):
        p, q = label[x], label[y]
        apart = p != q
        if not apart.any():
            break
        np.minimum.at(label, np.maximum(p, q)[apart], np.minimum(p, q)[apart])
        while (label[label] != label).any():
            label = label[label]
    return nodes, nodes[label]


def _in_one_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if found:
        nodes, roots = labelled(np.concatenate([a for a, _ in found]), np.concatenate([b for _, b in found]))
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(roots)], ["node", "root"])


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first())


def _large(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    hung = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return hung.union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def components(edges: DataFrame, most_rounds: int = 100) -> DataFrame:
    """(node, root) for every node of ``edges`` (columns a and b of one orderable type); root is the component's least node.

    Minima are combined before the shuffle and hubs meet their edges in joins that Spark can split, so no task holds
    all edges of a hub; a table of LOCAL_EDGES at most is bounded, and goes to one task. Rounds grow with the logarithm of the longest path. Loops and repeated edges do no harm; an
    edge with a null end is ignored; no edges give an empty result.
    """
    kind = edges.schema["a"].dataType
    now = durable(edges.where("a is not null and b is not null and a <> b").select("a", F.col("b").cast(kind).alias("b")).distinct())
    mark = _mark(now)
    if mark[0] <= LOCAL_EDGES and kind.simpleString() == "bigint":
        return now.coalesce(1).mapInArrow(_in_one_task, "node long, root long")
    with scope(edges.sparkSession):
        for _ in range(most_rounds):
            if not mark[0]:
                break
            now = durable(_small(_large(now)))
            if (then := _mark(now)) == mark:
                break
            mark = then
        else:
            raise RuntimeError(f"components didn't settle in {most_rounds} rounds")
        roots = now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
        return durable(now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots), keep=True)
