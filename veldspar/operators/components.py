"""Connected components of rasters of any size, and of any graph.

A raster comes in tiles of any cut. A task labels its tiles and hands on runs of pixels with the number of their patch;
runs at the borders of tiles that touch each other make a seam table, whose components unite the patches. So no task
holds a raster, and the graph has an edge for each contact at a seam, not for each pixel.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import stored
from .raster import labelled

#: Rounds after which a graph that hasn't settled is given up; they grow with the logarithm of its longest way.
ROUNDS = 60


def unite(edges: DataFrame) -> DataFrame:
    """(node, root): the least node of the component of each node of edges (a, b).

    Alternating stars: every node hands its larger neighbours its least one, then itself and its smaller ones. Least
    neighbours are aggregated before the shuffle, and hubs meet their neighbours in joins that Spark can split.
    """
    least = lambda e: e.groupBy("a").agg(F.min("b").alias("low"))
    now = stored(edges.where("a <> b").select("a", "b").distinct())
    before = None
    for _ in range(ROUNDS):
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == before or not mark[0]:
            break
        ways = now.union(now.select("b", "a"))
        low = least(ways).select("a", F.least("a", "low").alias("low"))
        wide = ways.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).where("a <> b").distinct()
        low = least(wide)
        now = stored(wide.join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b")).union(low.select("a", "low")).where("a <> b").distinct(), instead_of=now)
        before = mark
    else:
        raise RuntimeError(f"a component didn't settle in {ROUNDS} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(now.select("b", "b")).distinct()


def runs_of(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first, last) of the runs of marked pixels, by row."""
    step = np.diff(np.pad(mask.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    row, first = np.nonzero(step == 1)
    return row, first, np.nonzero(step == -1)[1] - 1


def patches(tiles: DataFrame, image: str, diagonal: bool = True) -> DataFrame:
    """(image, y, first, last, patch, border) of tiles (image, top, left, width, mask): runs of pixels with the number of their
    patch within the tile, and whether they lie at the tile's border."""
    kind = tiles.schema[image].dataType.simpleString()

    def made(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            found = []
            for name, top, left, width, mask in zip(*(batch[c] for c in (image, "top", "left", "width", "mask"))):
                mask = np.asarray(mask, dtype=bool).reshape(-1, width)
                names, n = labelled(mask, diagonal)
                y, first, last = runs_of(mask)
                border = (y == 0) | (y == len(mask) - 1) | (first == 0) | (last == width - 1)
                found.append(pd.DataFrame({image: [name] * len(y), "y": y + top, "first": first + left, "last": last + left, "patch": number + names[y, first], "border": border}))
                number += n
            if any(map(len, found)):
                yield pd.concat([f for f in found if len(f)])

    return tiles.select(image, "top", "left", "width", "mask").mapInPandas(made, f"`{image}` {kind}, y long, first long, last long, patch long, border boolean")


def touching(runs: DataFrame, image: str, diagonal: bool) -> DataFrame:
    """(a, b): patches of runs at borders that touch: in one row end to end, or in neighbouring rows."""
    edge = runs.where("border")
    x, reach = edge.select(image, "y", F.col("first").alias("x0"), F.col("last").alias("x1"), F.col("patch").alias("a")), int(diagonal)
    beside = edge.select(image, "y", (F.col("first") - 1).alias("x1"), F.col("patch").alias("b")).join(x, [image, "y", "x1"]).select("a", "b")
    below = edge.select(image, (F.col("y") - 1).alias("y"), "first", "last", F.col("patch").alias("b")).join(x, [image, "y"])
    met = below.where((F.col("first") <= F.col("x1") + reach) & (F.col("last") >= F.col("x0") - reach)).select("a", "b")
    return beside.union(met).where("a <> b")


def components(tiles: DataFrame, image: str = "image", diagonal: bool = True) -> DataFrame:
    """(image, y, first, last, component): runs of pixels, whose component is a number that is unique among all images."""
    runs = stored(patches(tiles, image, diagonal))
    roots = unite(touching(runs, image, diagonal)).select(F.col("node").alias("patch"), "root")
    return runs.join(roots, "patch", "left").select(image, "y", "first", "last", F.coalesce("root", "patch").alias("component"))


def extents(runs: DataFrame, image: str = "image") -> DataFrame:
    """(image, top, left_of_top, pixels, x0, y0, x1, y1) of each component: its first pixel by rows, size and box (ends
    included)."""
    start = F.min(F.struct("y", "first")).alias("start")
    box = [F.min("first").alias("x0"), F.min("y").alias("y0"), F.max("last").alias("x1"), F.max("y").alias("y1")]
    found = runs.groupBy(image, "component").agg(start, F.sum(F.col("last") - F.col("first") + 1).alias("pixels"), *box)
    return found.select(image, F.col("start.y").alias("top"), F.col("start.first").alias("left_of_top"), "pixels", "x0", "y0", "x1", "y1")


def whole(values: Column, width: int) -> list[Column]:
    """The columns of a tile that is a whole image: top, left, width and mask, an array of booleans by rows."""
    return [F.lit(0).alias("top"), F.lit(0).alias("left"), F.lit(width).alias("width"), values.alias("mask")]
