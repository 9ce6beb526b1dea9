"""Boards on photographs, and which way up they lie, from tables of runs of pixels.

Workers only mark pixels and cut them into runs; components, their sizes and boxes, the choice among them and all
decisions are relational. Images are rows (image, height, width, rgb), rgb by rows, red first, 0 to 1.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import stored
from .components import components, extents, runs_of, touching, unite
from .raster import closed, median_rows, resized

# Marked pixels: how far blue and green exceed red, and the saturation; how often the mask is closed.
BLUE_OVER_RED, GREEN_OVER_RED, SATURATION, CLOSINGS = 0.05, 0.03, 0.12, 3
# Width of the copy that is looked at; bounds on a board's share of the image; margins of the crop, across and down.
COPY_WIDTH, LEAST_SHARE, MOST_SHARE, MARGIN_X, MARGIN_Y = 512, 0.02, 0.65, 0.08, 0.45
# Pins: width of the running median, contrast with it, brightness, most spread of colours.
MEDIAN_WIDTH, CONTRAST, BRIGHTNESS, SPREAD = 15, 0.08, 0.35, 0.20
# Where they are looked for, in parts of the box: from and to across, reach above and below; their least height.
FROM_X, TO_X, REACH_Y, PIN_HEIGHT = 0.30, 0.70, 0.45, 0.10
# A board lies if it is so much wider than high; pins are so much higher than wide, and so many; the stronger side has so
# many times the pixels of the other.
LYING, SLENDER, PINS, DOMINANCE = 1.4, 3, 2, 3


def copy_of(rgb: np.ndarray, width: int) -> np.ndarray:
    """The image at another width, its height in proportion."""
    if width == rgb.shape[1]:
        return rgb
    height = max(1, round(rgb.shape[0] * width / rgb.shape[1]))
    return np.stack([resized(plane, height, width) for plane in np.moveaxis(rgb, 2, 0)], axis=2)


def board_mask(rgb: np.ndarray) -> np.ndarray:
    """Bluish and greenish saturated pixels, closed."""
    red, green, blue = np.moveaxis(rgb, 2, 0)
    strongest = rgb.max(axis=2)
    colourful = strongest - rgb.min(axis=2) > SATURATION * np.maximum(strongest, 1e-6)
    return closed(colourful & (blue > red + BLUE_OVER_RED) & (green > red + GREEN_OVER_RED), CLOSINGS)


def _per_image(images: DataFrame, more: list[str], made: Callable[..., dict], schema: str) -> DataFrame:
    """Rows of ``made(rgb, *more)``, columns by name, for each image, with the image's name."""
    kind = images.schema["image"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                height, width, pixels = (batch.column(c)[i].as_py() if c < 3 else batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in (1, 2, 3))
                found = made(pixels.reshape(height, width, 3), *(batch.column(c)[i].as_py() for c in range(4, batch.num_columns)))
                names = batch.column(0).take(pa.array(np.full(len(next(iter(found.values()))), i)))
                yield pa.RecordBatch.from_arrays([names, *found.values()], ["image", *found])

    return images.select("image", "height", "width", "rgb", *more).mapInArrow(run, f"image {kind}, {schema}")


def boards(images: DataFrame, copy_width: int = COPY_WIDTH) -> DataFrame:
    """(image, share, x0, y0, x1, y1, left, top, right, bottom, failure): the largest component of marked pixels (of four
    neighbours; the first by rows if several are as large), its box on the image, ends excluded, and the crop with margins.
    If the share is out of bounds or nothing is marked, there is no box and the crop is the whole image."""

    def tiles(rgb: np.ndarray) -> dict:
        mask = board_mask(copy_of(rgb, min(copy_width, rgb.shape[1])))
        at = pa.array([0], pa.int32())
        return {"top": at, "left": at, "width": pa.array([mask.shape[1]], pa.int32()), "mask": pa.ListArray.from_arrays(pa.array([0, mask.size], pa.int32()), pa.array(mask.ravel()))}

    found = extents(components(_per_image(images, [], tiles, "top int, left int, width int, mask array<boolean>"), diagonal=False))
    best = found.groupBy("image").agg(F.max(F.struct("pixels", (-F.col("top")).alias("t"), (-F.col("left_of_top")).alias("l"), "x0", "y0", "x1", "y1")).alias("m"))
    copy_w = F.least(F.col("width"), F.lit(copy_width))
    copy_h = F.when(copy_w == F.col("width"), F.col("height")).otherwise(F.greatest(F.lit(1), F.bround(F.col("height") * copy_w / F.col("width")).cast("int")))
    met = images.select("image", "height", "width", copy_w.alias("copy_w"), copy_h.alias("copy_h")).join(best, "image", "left")
    share = F.coalesce(F.col("m.pixels") / (F.col("copy_w") * F.col("copy_h")), F.lit(0.0))
    met = met.withColumn("share", share).withColumn("ok", F.col("share").between(LEAST_SHARE, MOST_SHARE) & F.col("m").isNotNull())
    down = lambda c, n, of: F.floor(c * F.col(n) / F.col(of))
    up = lambda c, n, of: F.ceil((c + 1) * F.col(n) / F.col(of))
    boxed = met.withColumns({
        "x0": down(F.col("m.x0"), "width", "copy_w"), "y0": down(F.col("m.y0"), "height", "copy_h"), "x1": up(F.col("m.x1"), "width", "copy_w"), "y1": up(F.col("m.y1"), "height", "copy_h"),
    })
    mx, my = MARGIN_X * (F.col("x1") - F.col("x0")), MARGIN_Y * (F.col("y1") - F.col("y0"))
    crop = {
        "left": F.when(F.col("ok"), F.greatest(F.lit(0), F.floor(F.col("x0") - mx))).otherwise(0), "top": F.when(F.col("ok"), F.greatest(F.lit(0), F.floor(F.col("y0") - my))).otherwise(0),
        "right": F.when(F.col("ok"), F.least(F.col("width"), F.ceil(F.col("x1") + mx))).otherwise(F.col("width")), "bottom": F.when(F.col("ok"), F.least(F.col("height"), F.ceil(F.col("y1") + my))).otherwise(F.col("height")),
    }
    failure = F.when(F.col("m").isNull(), "no component").when(~F.col("ok"), "share out of bounds")
    box = [F.when(F.col("ok"), F.col(c)).cast("int").alias(c) for c in ("x0", "y0", "x1", "y1")]
    return boxed.select("image", "share", *box, *[c.cast("int").alias(n) for n, c in crop.items()], failure.alias("failure"))


def strokes(rgb: np.ndarray, x0: float, y0: float, x1: float, y1: float) -> dict:
    """(side, x, first, last, least): upright runs of ridge pixels above and below a box, as long as a pin at least."""
    wide, high = x1 - x0, y1 - y0
    least, out = max(3, round(PIN_HEIGHT * high)), []
    columns = slice(max(0, round(x0 + FROM_X * wide)), min(rgb.shape[1], round(x0 + TO_X * wide)))
    for side, above, below in (("above", y0 - REACH_Y * high, y0), ("below", y1, y1 + REACH_Y * high)):
        part = rgb[max(0, round(above)) : min(len(rgb), round(below))]  # medians of these rows and columns alone
        grey = part.mean(axis=2)
        near = grey[:, columns]
        ridge = (near > BRIGHTNESS) & (np.ptp(part[:, columns], axis=2) < SPREAD) & (near - median_rows(grey, MEDIAN_WIDTH, columns) > CONTRAST)
        x, first, last = runs_of(ridge.T)
        long = last - first + 1 >= least
        out.append((np.full(int(long.sum()), side, dtype=object), x[long], first[long], last[long], np.full(int(long.sum()), least)))
    side, *numbers = (np.concatenate(c) for c in zip(*out))
    return {"side": pa.array(side, pa.string())} | {n: pa.array(c, pa.int64()) for n, c in zip(("x", "first", "last", "least"), numbers)}


def poses(images: DataFrame, boxes: DataFrame, copy_width: int = COPY_WIDTH) -> DataFrame:
    """(image, pose, reason, pins_above, pins_below, pixels_above, pixels_below, dominance) of images and their boxes (image,
    x0, y0, x1, y1, null without a board): canonical if pins stand out above the board, reversed_180 if below."""
    met = images.join(boxes.select("image", "x0", "y0", "x1", "y1"), "image")
    lies = (F.col("x1") - F.col("x0")) >= LYING * (F.col("y1") - F.col("y0"))

    def made(rgb: np.ndarray, *box: float) -> dict:
        return strokes(copy_of(rgb, copy_width), *(v * copy_width / rgb.shape[1] for v in box))

    found = _per_image(met.where(F.coalesce(lies, F.lit(False))), ["x0", "y0", "x1", "y1"], made, "side string, x long, first long, last long, least long")
    # upright runs are rows of the turned image: strokes of several columns are runs that touch
    keyed = found.select(F.struct("image", "side").alias("image"), F.col("x").alias("y"), "first", "last", "least").withColumn("patch", F.monotonically_increasing_id()).withColumn("border", F.lit(True))
    pins = _united(keyed)
    size = pins.groupBy("image", "component").agg(F.min("least").alias("least"), F.sum(F.col("last") - F.col("first") + 1).alias("pixels"), (F.max("last") - F.min("first") + 1).alias("high"), (F.max("y") - F.min("y") + 1).alias("wide"))
    upright = size.where((F.col("high") >= F.col("least")) & (F.col("high") >= SLENDER * F.col("wide")))
    on = lambda side, c: F.coalesce(F.sum(F.when(F.col("image.side") == side, c)), F.lit(0))
    sides = upright.groupBy(F.col("image.image").alias("image")).agg(*[on(s, c).alias(f"{n}_{s}") for s in ("above", "below") for n, c in (("pins", F.lit(1)), ("pixels", F.col("pixels")))])
    all_ = met.select("image", "x0", lies.alias("lies")).join(sides, "image", "left").fillna(0, ["pins_above", "pins_below", "pixels_above", "pixels_below"])

    def leads(side: str, other: str) -> Column:
        return (F.col(f"pins_{side}") >= PINS) & (F.col(f"pixels_{side}") >= DOMINANCE * F.greatest(F.lit(1), F.col(f"pixels_{other}")))

    pose = F.when(leads("above", "below"), "canonical").when(leads("below", "above"), "reversed_180").otherwise("uncertain")
    reason = F.when(F.col("x0").isNull(), "no board").when(~F.col("lies"), "not lying").when(F.col("pose") == "uncertain", "ambiguous").otherwise("")
    stronger, weaker = F.greatest("pixels_above", "pixels_below"), F.greatest(F.lit(1), F.least("pixels_above", "pixels_below"))
    out = all_.withColumn("pose", pose).withColumn("reason", reason).withColumn("dominance", F.when(F.col("lies"), stronger / weaker))
    return out.select("image", "pose", "reason", *[F.col(c).cast("long").alias(c) for c in ("pins_above", "pins_below", "pixels_above", "pixels_below")], "dominance")


def _united(runs: DataFrame) -> DataFrame:
    """Runs (image, y, first, last, patch, border, ...) with the component of four neighbours that each is of."""
    held = stored(runs)
    roots = unite(touching(held, "image", False)).select(F.col("node").alias("patch"), "root")
    return held.join(roots, "patch", "left").withColumn("component", F.coalesce("root", "patch")).drop("patch", "root", "border")
