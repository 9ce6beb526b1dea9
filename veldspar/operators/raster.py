"""Rasters: pixel tables for counts across images, arrays per image for geometry.

A pixel table has image, y, x and values; what is counted per image, cell or group is aggregation. Operations that
need a neighbourhood work on one image's array at a time (``per_image``).
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import safe_ratio


def pixels(df: DataFrame, image: str, values: dict[str, str], width: int) -> DataFrame:
    """One row per pixel of row-major arrays of one length: image, y, x and a column per array."""
    zipped = F.arrays_zip(*[F.col(v).alias(k) for k, v in values.items()])
    rows = df.select(F.col(image), F.posexplode(zipped).alias("pos", "p"))
    return rows.select(image, F.expr(f"pos div {width}").cast("int").alias("y"), (F.col("pos") % width).alias("x"), *[F.col(f"p.{k}").alias(k) for k in values])


def overlap(px: DataFrame, by: list[str], truth: Column, found: Column) -> DataFrame:
    """Pixel counts and their ratios of each group, or of all pixels together."""
    out = px.groupBy(*by).agg(
        F.count("*").alias("pixels"), F.count_if(truth).alias("truth"), F.count_if(found).alias("found"), F.count_if(truth & found).alias("both"), F.count_if(truth | found).alias("either")
    )
    return out.withColumn("iou", safe_ratio(F.col("both"), F.col("either")))


def peak(px: DataFrame, image: str, score: str, truth: Column) -> DataFrame:
    """Each image's highest score, its first place in rows, how many share it, and whether that place is in the truth."""
    place = F.struct((-F.col(score)).alias("s"), "y", "x", truth.alias("inside"))
    top = px.groupBy(image).agg(F.min(place).alias("m"), F.max(score).alias("peak"))
    ties = px.groupBy(image, score).agg(F.count("*").alias("ties")).withColumnRenamed(score, "peak")
    return top.join(ties, [image, "peak"]).select(image, "peak", F.col("m.y").alias("y"), F.col("m.x").alias("x"), F.col("m.inside").alias("peak_inside"), "ties")


def cell(v: Column, size: int, cells: int = 4) -> Column:
    """The number of the cell of a grid over 0..size that holds the centre of a pixel."""
    return F.least(F.floor((v + 0.5) * cells / size), F.lit(cells - 1)).cast("int")


def grid(px: DataFrame, by: list[str], height: int, width: int, counts: dict[str, Column], cells: int = 4) -> DataFrame:
    """Sums of conditions per cell, and their share of the cell's pixels."""
    at = px.withColumns({"grid_row": cell(F.col("y"), height, cells), "grid_col": cell(F.col("x"), width, cells)})
    out = at.groupBy(*by, "grid_row", "grid_col").agg(F.count("*").alias("pixels"), *[F.count_if(c).alias(k) for k, c in counts.items()])
    return out.select("*", *[safe_ratio(F.col(k), F.col("pixels")).alias(f"{k}_rate") for k in counts])


def footprint(px: DataFrame, image: str, truth: Column, size: int = 8) -> DataFrame:
    """Cells of ``size`` pixels a side: whether any pixel is in the truth, the share that is, and the ring of cells
    around those that are."""
    cells = px.groupBy(image, F.expr(f"y div {size}").cast("int").alias("cy"), F.expr(f"x div {size}").cast("int").alias("cx")).agg(F.avg(truth.cast("double")).alias("share"))
    inside = cells.where("share > 0").select(image, "cy", "cx")
    steps = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b])).alias("d")
    near = inside.select(image, "cy", "cx", steps).select(image, (F.col("cy") + F.col("d.a")).alias("cy"), (F.col("cx") + F.col("d.b")).alias("cx")).distinct()
    marked = cells.join(near.withColumn("near", F.lit(True)), [image, "cy", "cx"], "left")
    return marked.select(image, "cy", "cx", "share", (F.col("share") > 0).alias("inside"), (F.coalesce("near", F.lit(False)) & (F.col("share") == 0)).alias("ring"))


def turned(px: DataFrame, height: int, width: int, when: Column) -> DataFrame:
    """Pixels of the images where ``when`` holds turned by 180 degrees, all others untouched."""
    return px.withColumns({"y": F.when(when, height - 1 - F.col("y")).otherwise(F.col("y")), "x": F.when(when, width - 1 - F.col("x")).otherwise(F.col("x"))})


def map_change(before: DataFrame, after: DataFrame, image: str, score: str, truth: str, threshold: float) -> DataFrame:
    """Per image, what a second map adds to and removes from the pixels above the threshold, inside and outside the
    truth, and the range of the change."""
    met = before.select(image, "y", "x", F.col(score).alias("a"), F.col(truth).alias("t")).join(after.select(image, "y", "x", F.col(score).alias("b")), [image, "y", "x"])
    gone, new, d = (F.col("a") > threshold) & ~(F.col("b") > threshold), ~(F.col("a") > threshold) & (F.col("b") > threshold), F.col("b") - F.col("a")
    return met.groupBy(image).agg(
        F.count_if(gone & F.col("t")).alias("removed_inside"), F.count_if(gone & ~F.col("t")).alias("removed_outside"), F.count_if(new & F.col("t")).alias("added_inside"),
        F.count_if(new & ~F.col("t")).alias("added_outside"), F.avg(d).alias("mean_delta"), F.min(d).alias("min_delta"), F.max(d).alias("max_delta"), F.max(F.abs(d)).alias("max_abs_delta"),
    )


def sampled(values: Column, y: Column, x: Column, height: int, width: int) -> Column:
    """The value of a row-major array at continuous coordinates, rounded half-even and clamped to the border."""
    at = lambda v, n: F.greatest(F.lit(0), F.least(F.bround(v).cast("int"), F.lit(n - 1)))
    return F.element_at(values, (at(y, height) * width + at(x, width) + 1).cast("int"))


def per_image(df: DataFrame, image: str, values: str, width: int, function: Callable[[np.ndarray], dict], schema: str) -> DataFrame:
    """Apply a function of one image's array (height x width) to each row; its results are the columns of ``schema``."""
    kind = df.schema[image].dataType.simpleString()

    def made(batches):
        for batch in batches:
            rows = [function(np.asarray(v, dtype=float).reshape(-1, width)) for v in batch[values]]
            yield pd.concat([batch[[image]].reset_index(drop=True), pd.DataFrame(rows)], axis=1)

    return df.select(image, values).mapInPandas(made, f"`{image}` {kind}, {schema}")


def labelled(mask: np.ndarray, diagonal: bool = True) -> tuple[np.ndarray, int]:
    """Numbers of the connected components of a mask, 0 outside, in order of their first pixel; by union-find over runs of
    pixels in rows, which touch runs of the row above."""
    edges = np.diff(np.pad(mask.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    ys, begin = np.nonzero(edges == 1)
    end = np.nonzero(edges == -1)[1]
    first = np.searchsorted(ys, np.arange(mask.shape[0] + 1)).tolist()
    begin, end, root, more = begin.tolist(), end.tolist(), list(range(len(ys))), int(diagonal)

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for y in range(1, mask.shape[0]):
        i, j = first[y - 1], first[y]
        while i < first[y] and j < first[y + 1]:
            if begin[i] < end[j] + more and begin[j] < end[i] + more:
                p, q = find(i), find(j)
                root[max(p, q)] = min(p, q)
            if end[i] <= end[j]:
                i += 1
            else:
                j += 1
    out, names = np.zeros(mask.shape, dtype=int), {}
    for i, y in enumerate(ys.tolist()):
        out[y, begin[i] : end[i]] = names.setdefault(find(i), len(names) + 1)
    return out, len(names)


def extent(mask: np.ndarray) -> dict:
    """Components of a mask and its bounding box."""
    ys, xs = np.nonzero(mask)
    area = (int(ys.max() - ys.min()) + 1) * (int(xs.max() - xs.min()) + 1) if len(ys) else 0
    return {"components": labelled(mask)[1], "box_area": area, "box_share": area / mask.size}


def dilated(mask: np.ndarray) -> np.ndarray:
    """A mask grown by its four neighbours."""
    out = mask.copy()
    out[1:] |= mask[:-1]
    out[:-1] |= mask[1:]
    out[:, 1:] |= mask[:, :-1]
    out[:, :-1] |= mask[:, 1:]
    return out


def closed(mask: np.ndarray, times: int = 3) -> np.ndarray:
    """Dilation, then erosion by four neighbours, each so many times; what is outside the image counts as background for
    both, so that erosion eats in from the border."""
    out = mask
    for _ in range(times):
        out = dilated(out)
    for _ in range(times):
        out = ~dilated(np.pad(~out, 1, constant_values=True))[1:-1, 1:-1]
    return out


def resized(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Bilinear, by pixel centres, clamped at the border."""
    def axis(n: int, to: int):
        at = np.clip((np.arange(to) + 0.5) * n / to - 0.5, 0, n - 1)
        low = np.floor(at).astype(int)
        return low, np.minimum(low + 1, n - 1), at - low

    y0, y1, fy = axis(image.shape[0], height)
    x0, x1, fx = axis(image.shape[1], width)
    top = image[y0][:, x0] * (1 - fx) + image[y0][:, x1] * fx
    low = image[y1][:, x0] * (1 - fx) + image[y1][:, x1] * fx
    return top * (1 - fy)[:, None] + low * fy[:, None]


def letterbox(height: Column, width: Column, size: int) -> Column:
    """content_height, content_width, pad_y, pad_x of an image fitted into a square, sides rounded half-even."""
    scale = size / F.greatest(height, width)
    ch, cw = F.greatest(F.lit(1), F.bround(height * scale).cast("int")), F.greatest(F.lit(1), F.bround(width * scale).cast("int"))
    half = lambda v: F.floor((F.lit(size) - v) / 2).cast("int")
    return F.struct(ch.alias("content_height"), cw.alias("content_width"), half(ch).alias("pad_y"), half(cw).alias("pad_x"))


def cell_centre(row: Column, column: Column, box: Column, left: Column, top: Column, height: Column, width: Column, cell: int = 8) -> Column:
    """Where the centre of a cell of a letterboxed map lies: nx and ny within the crop's content (0 to 1), source_x and
    source_y on the image, padding if it is outside the content, and the third of the crop that holds it."""
    nx = ((column + 0.5) * cell - box["pad_x"]) / box["content_width"]
    ny = ((row + 0.5) * cell - box["pad_y"]) / box["content_height"]
    padding = ~((nx >= 0) & (nx < 1) & (ny >= 0) & (ny < 1))
    third = lambda v: F.least(F.lit(2), F.floor(v * 3).cast("int")).cast("string")
    region = F.when(padding, "padding_center").otherwise(F.concat(F.lit("row"), third(ny), F.lit("_col"), third(nx)))
    return F.struct(nx.alias("nx"), ny.alias("ny"), (left + nx * width).alias("source_x"), (top + ny * height).alias("source_y"), padding.alias("padding"), region.alias("region"))


def boxed(image: np.ndarray, size: int, grey: float = 128.0) -> tuple[np.ndarray, dict]:
    """An image fitted into a square on grey, with its geometry."""
    h, w = image.shape
    scale = size / max(h, w)
    ch, cw = max(1, round(h * scale)), max(1, round(w * scale))
    py, px = (size - ch) // 2, (size - cw) // 2
    out = np.full((size, size), grey)
    out[py : py + ch, px : px + cw] = resized(image, ch, cw)
    return out, {"content_height": ch, "content_width": cw, "pad_y": py, "pad_x": px}


def unboxed(score: np.ndarray, geometry: dict, crop: tuple[int, int, int, int], height: int, width: int, turn: bool = False, common: int | None = None) -> np.ndarray:
    """A square map back on its source: without padding, turned if asked, resized to the crop, 0 outside it; then at a common
    size of so many pixels a side, if asked."""
    y, x = geometry["pad_y"], geometry["pad_x"]
    inner = score[y : y + geometry["content_height"], x : x + geometry["content_width"]]
    inner = inner[::-1, ::-1] if turn else inner
    left, top, right, bottom = crop
    out = np.zeros((height, width))
    out[top:bottom, left:right] = resized(inner, bottom - top, right - left)
    return out if common is None else resized(out, common, common)


def tensor(rgb: np.ndarray, means: tuple = (0.485, 0.456, 0.406), spreads: tuple = (0.229, 0.224, 0.225)) -> np.ndarray:
    """Channels first, less their means, in units of their spreads; of an image (height, width, 3; 0 to 1)."""
    return ((rgb - np.array(means)) / np.array(spreads)).transpose(2, 0, 1)


def median_rows(image: np.ndarray, width: int = 15, columns: slice = slice(None)) -> np.ndarray:
    """Each pixel's median over ``width`` pixels of its row, which is mirrored at its ends; of some columns."""
    half = width // 2
    wide = np.pad(image, ((0, 0), (half, half)), mode="symmetric")
    return np.median(np.lib.stride_tricks.sliding_window_view(wide, width, axis=1)[:, columns], axis=-1)


def difference_hash(image: np.ndarray) -> int:
    """64 bits that tell where brightness rises to the right on a 9 x 8 thumbnail, as a signed number."""
    small = resized(image, 8, 9)
    bits = np.packbits((small[:, 1:] > small[:, :-1]).ravel())
    return int(bits.view(">i8")[0])


#: Functions from an image to a list of numbers, by name; a network that needs libraries of its own is put here.
EXTRACTORS: dict[str, Callable[[np.ndarray], list[float]]] = {}


def register(name: str, extractor: Callable[[np.ndarray], list[float]]) -> None:
    EXTRACTORS[name] = extractor


def features(df: DataFrame, image: str, values: str, width: int, name: str) -> DataFrame:
    """(image, features) of arrays by rows, by a registered extractor, which goes to the workers."""
    extractor = EXTRACTORS[name]
    return per_image(df, image, values, width, lambda a: {"features": [float(x) for x in extractor(a)]}, "features array<double>")


def _bytes_of(row: pd.Series) -> np.ndarray:
    return np.frombuffer(row["data"], dtype=np.uint8).reshape(row["height"], row["width"], row["channels"])


def decoded(images: DataFrame) -> DataFrame:
    """(path, height, width, rgb) of decoded images (path, height, width, channels, data): by rows, red first, 0 to 1; grey
    is repeated, and a fourth channel is left out."""

    def made(batches):
        for batch in batches:
            rgb = [np.repeat(p, 3, axis=2) if p.shape[2] == 1 else p[:, :, 2::-1] for p in (_bytes_of(r) for _, r in batch.iterrows())]
            yield pd.DataFrame({"path": batch["path"], "height": batch["height"], "width": batch["width"], "rgb": [(p / 255).ravel().tolist() for p in rgb]})

    return images.select("path", "height", "width", "channels", "data").mapInPandas(made, "path string, height int, width int, rgb array<double>")


def masks(images: DataFrame, height: int, width: int) -> DataFrame:
    """(path, mask) of decoded masks at another size by the nearest pixel: whether it is above 0 in any channel."""

    def at(n: int, to: int) -> np.ndarray:
        return np.minimum(((np.arange(to) + 0.5) * n / to).astype(int), n - 1)

    def made(batches):
        for batch in batches:
            found = [(_bytes_of(r) > 0).any(axis=2) for _, r in batch.iterrows()]
            yield pd.DataFrame({"path": batch["path"], "mask": [m[at(m.shape[0], height)][:, at(m.shape[1], width)].ravel().tolist() for m in found]})

    return images.select("path", "height", "width", "channels", "data").mapInPandas(made, "path string, mask array<boolean>")
