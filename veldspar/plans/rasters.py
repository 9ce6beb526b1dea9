"""Pixel tables and geometry."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from ..functions.scalar import rounded, safe_ratio
from ..operators import boards, components, governance, knn
from ..operators import raster as ops
from ..sources.scratch import shared_dir, stored
from .base import RASTER, query, raster, raster_rows, six

#: Images whose pixels are laid out at once.
IMAGES = 256


@query("A21 Q9", f"WITH {RASTER} SELECT label, count(*) AS pixels, count(*) FILTER (truth) AS truth, count(*) FILTER (score > 0.12) AS found, count(*) FILTER (truth AND score > 0.12) AS both, count(*) FILTER (truth OR score > 0.12) AS either, round(count(*) FILTER (truth AND score > 0.12) / nullif(count(*) FILTER (truth OR score > 0.12), 0), 6) AS iou FROM px GROUP BY label")
def pixel_iou(spark, sf_dir):
    px = raster(spark, sf_dir).join(raster_rows(spark, sf_dir).select("vec_id", "label"), "vec_id")
    return six(ops.overlap(px, ["label"], F.col("truth"), F.col("score") > 0.12), "iou")


@query("Q9 W16", f"WITH {RASTER}, r AS (SELECT *, max(score) OVER (PARTITION BY vec_id) AS peak, row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, y, x) AS i FROM px), t AS (SELECT vec_id, count(*) FILTER (score = peak) AS ties FROM r GROUP BY vec_id) SELECT vec_id, round(peak, 6) AS peak, y, x, truth AS peak_inside, ties FROM r JOIN t USING (vec_id) WHERE i = 1")
def pixel_peak(spark, sf_dir):
    return six(ops.peak(raster(spark, sf_dir), "vec_id", "score", F.col("truth")), "peak")


@query("Q9 Q5", f"""WITH {RASTER}, g AS (SELECT vec_id, score, count(*) FILTER (truth) AS pos, count(*) AS n FROM px GROUP BY vec_id, score), c AS (SELECT *, sum(pos) OVER w AS cp, sum(n) OVER w AS cn, sum(pos) OVER (PARTITION BY vec_id) AS p FROM g WINDOW w AS (PARTITION BY vec_id ORDER BY score DESC))
SELECT vec_id, round(sum(pos * cp / cn) / nullif(max(p), 0), 6) AS pixel_ap FROM c GROUP BY vec_id""")
def pixel_average_precision(spark, sf_dir):
    from pyspark.sql.window import Window

    g = raster(spark, sf_dir).groupBy("vec_id", "score").agg(F.count_if("truth").alias("pos"), F.count("*").alias("n"))
    own = Window.partitionBy("vec_id").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    c = g.withColumns({"cp": F.sum("pos").over(own), "cn": F.sum("n").over(own)})
    return six(c.groupBy("vec_id").agg(safe_ratio(F.sum(F.col("pos") * F.col("cp") / F.col("cn")), F.sum("pos")).alias("pixel_ap")), "pixel_ap")


@query("G8 G11 A12", f"WITH {RASTER} SELECT label, y // 2 AS grid_row, x // 2 AS grid_col, count(*) AS pixels, count(*) FILTER (truth) AS truth, count(*) FILTER (score > 0.12 AND NOT truth) AS wrong, round(count(*) FILTER (truth) / count(*), 6) AS truth_rate, round(count(*) FILTER (score > 0.12 AND NOT truth) / count(*), 6) AS wrong_rate FROM px GROUP BY label, y // 2, x // 2")
def grid_cell_rollup(spark, sf_dir):
    px = raster(spark, sf_dir).join(raster_rows(spark, sf_dir).select("vec_id", "label"), "vec_id")
    return six(ops.grid(px, ["label"], 8, 8, {"truth": F.col("truth"), "wrong": (F.col("score") > 0.12) & ~F.col("truth")}), "truth_rate", "wrong_rate")


@query("A18", f"WITH {RASTER} SELECT label, y, x, round(avg(score), 6) AS mean, round(avg(CASE WHEN score > 0.12 THEN 1.0 ELSE 0.0 END), 6) AS above FROM px GROUP BY label, y, x")
def mean_raster(spark, sf_dir):
    px = raster(spark, sf_dir).join(raster_rows(spark, sf_dir).select("vec_id", "label"), "vec_id")
    return six(px.groupBy("label", "y", "x").agg(F.avg("score").alias("mean"), F.avg((F.col("score") > 0.12).cast("double")).alias("above")), "mean", "above")


@query("G13", f"""WITH {RASTER}, c AS (SELECT vec_id, y // 2 AS cy, x // 2 AS cx, avg(CASE WHEN truth THEN 1.0 ELSE 0.0 END) AS share FROM px GROUP BY vec_id, y // 2, x // 2),
r AS (SELECT DISTINCT a.vec_id, a.cy, a.cx FROM c a JOIN c b ON a.vec_id = b.vec_id AND greatest(abs(a.cy - b.cy), abs(a.cx - b.cx)) = 1 AND b.share > 0)
SELECT c.vec_id, c.cy, c.cx, round(c.share, 6) AS share, c.share > 0 AS inside, r.vec_id IS NOT NULL AND c.share = 0 AS ring FROM c LEFT JOIN r ON c.vec_id = r.vec_id AND c.cy = r.cy AND c.cx = r.cx""")
def mask_cells(spark, sf_dir):
    return six(ops.footprint(raster(spark, sf_dir), "vec_id", F.col("truth"), 2), "share")


@query("G6 G15", f"""WITH {RASTER}, b AS (SELECT vec_id, y, x, truth, score FROM px), a AS (SELECT vec_id, CASE WHEN label % 2 = 1 THEN 7 - y ELSE y END AS y, CASE WHEN label % 2 = 1 THEN 7 - x ELSE x END AS x, score FROM px), m AS (SELECT b.vec_id, b.truth AS t, b.score AS a, a.score AS b FROM b JOIN a USING (vec_id, y, x))
SELECT vec_id, count(*) FILTER (a > 0.12 AND NOT b > 0.12 AND t) AS removed_inside, count(*) FILTER (a > 0.12 AND NOT b > 0.12 AND NOT t) AS removed_outside, count(*) FILTER (NOT a > 0.12 AND b > 0.12 AND t) AS added_inside, count(*) FILTER (NOT a > 0.12 AND b > 0.12 AND NOT t) AS added_outside,
round(avg(b - a), 6) + 0.0 AS mean_delta, round(min(b - a), 6) AS min_delta, round(max(b - a), 6) AS max_delta, round(max(abs(b - a)), 6) AS max_abs_delta FROM m GROUP BY vec_id""")
def map_change(spark, sf_dir):
    px = raster(spark, sf_dir).join(raster_rows(spark, sf_dir).select("vec_id", "label"), "vec_id")
    out = ops.map_change(px, ops.turned(px, 8, 8, F.col("label") % 2 == 1), "vec_id", "score", "truth", 0.12)
    return six(out, "mean_delta", "min_delta", "max_delta", "max_abs_delta")


@query("G18 G19", f"""WITH {RASTER}, g AS (SELECT vec_id, avg(CASE WHEN truth THEN 1.0 ELSE 0.0 END) AS area, count(*) FILTER (truth AND score > 0.12) AS i, count(*) FILTER (truth OR score > 0.12) AS u, count(*) FILTER (truth AND (y < 1 OR y > 6)) AS outside, count(*) FILTER (truth) AS t FROM px GROUP BY vec_id)
SELECT vec_id, CAST(round_even(area * 64, 0) AS BIGINT) AS gt, u - CAST(round_even(area * 64, 0) AS BIGINT) AS fp, CAST(round_even(area * 64, 0) AS BIGINT) - i AS fn, round(outside / nullif(t, 0), 6) AS outside_share FROM g""")
def pixel_accounting(spark, sf_dir):
    px = raster(spark, sf_dir)
    hit = F.col("score") > 0.12
    g = px.groupBy("vec_id").agg(F.avg(F.col("truth").cast("double")).alias("area"), F.count_if(F.col("truth") & hit).alias("i"), F.count_if(F.col("truth") | hit).alias("u"), F.count_if(F.col("truth") & ~F.col("y").between(1, 6)).alias("outside"), F.count_if("truth").alias("t"))
    gt = F.bround(F.col("area") * 64).cast("long")
    return g.select("vec_id", gt.alias("gt"), (F.col("u") - gt).alias("fp"), (gt - F.col("i")).alias("fn"), rounded(safe_ratio(F.col("outside"), F.col("t"))).alias("outside_share"))


@query("G2", """WITH s AS (SELECT p_partkey, p_size + 20 AS h, CAST(p_retailprice AS BIGINT) % 400 + 30 AS w FROM part), c AS (SELECT *, greatest(1, CAST(round_even(h * (64 / greatest(h, w)), 0) AS INTEGER)) AS ch, greatest(1, CAST(round_even(w * (64 / greatest(h, w)), 0) AS INTEGER)) AS cw FROM s)
SELECT p_partkey, ch AS content_height, cw AS content_width, CAST(floor((64 - ch) / 2) AS INTEGER) AS pad_y, CAST(floor((64 - cw) / 2) AS INTEGER) AS pad_x FROM c""")
def letterbox_geometry(spark, sf_dir):
    from ..sources.files import read_table

    p = read_table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") + 20).alias("h"), (F.bround("p_retailprice").cast("long") % 400 + 30).alias("w"))
    return p.select("p_partkey", ops.letterbox(F.col("h"), F.col("w"), 64).alias("g")).select("p_partkey", "g.*")


@query("G9", "SELECT vec_id, CAST(embedding[CAST(greatest(0, least(round_even(vec_id % 23 / 2.0 - 1, 0), 7)) AS INTEGER) * 8 + CAST(greatest(0, least(round_even(vec_id % 31 / 3.0, 0), 7)) AS INTEGER) + 1] AS DOUBLE) > 0.1 AS hit FROM embeddings")
def sampled_truth(spark, sf_dir):
    r = raster_rows(spark, sf_dir)
    return r.select("vec_id", (ops.sampled(F.col("score"), F.col("vec_id") % 23 / 2.0 - 1, F.col("vec_id") % 31 / 3.0, 8, 8) > 0.1).alias("hit"))


_RUNS = """r AS (SELECT image, y, min(x) AS a, max(x) AS b FROM (SELECT image, y, x, x - row_number() OVER (PARTITION BY image, y ORDER BY x) AS g FROM on_) GROUP BY image, y, g),
c AS (SELECT image, y, a, b, y AS ry, a AS ra FROM r UNION SELECT n.image, n.y, n.a, n.b, c.ry, c.ra FROM c JOIN r n ON n.image = c.image AND abs(n.y - c.y) = 1 AND n.a <= c.b + {0} AND n.b >= c.a - {0}),
k AS (SELECT image, y, a, b, min(struct_pack(y := ry, x := ra)) AS root FROM c GROUP BY image, y, a, b)"""


@query("G10", f"""WITH RECURSIVE {RASTER}, on_ AS (SELECT vec_id AS image, y, x FROM px WHERE score > 0.12), {_RUNS.format(1)},
s AS (SELECT image, count(DISTINCT root) AS n, (max(b) - min(a) + 1) * (max(y) - min(y) + 1) AS area FROM k GROUP BY image)
SELECT vec_id, CAST(coalesce(n, 0) AS INTEGER) AS components, CAST(coalesce(area, 0) AS INTEGER) AS box_area, coalesce(area, 0) / 64 AS box_share FROM embeddings LEFT JOIN s ON image = vec_id""")
def map_components(spark, sf_dir):
    """Components and bounding box of what is above the threshold, per image."""
    rows = raster_rows(spark, sf_dir)
    tiles = rows.select("vec_id", *components.whole(F.transform("score", lambda x: x > 0.12), 8))
    each = components.extents(components.components(tiles, "vec_id"), "vec_id").groupBy("vec_id")
    area = (F.max("x1") - F.min("x0") + 1) * (F.max("y1") - F.min("y0") + 1)
    found = rows.select("vec_id").join(each.agg(F.count("*").cast("int").alias("components"), area.cast("int").alias("box_area")), "vec_id", "left").fillna(0)
    return found.withColumn("box_share", F.col("box_area") / 64)


@query("G10", f"""WITH RECURSIVE {RASTER}, on_ AS (SELECT 0 AS image, vec_id * 8 + y AS y, x FROM px WHERE score > 0.1), {_RUNS.format(1)}
SELECT min(y) AS top, min(root.x) AS left_of_top, CAST(sum(b - a + 1) AS BIGINT) AS pixels, min(a) AS x0, min(y) AS y0, max(b) AS x1, max(y) AS y1 FROM k GROUP BY root""")
def strip_components(spark, sf_dir):
    """All maps below each other are one raster, of which each is a tile: components across the tiles."""
    tiles = raster_rows(spark, sf_dir).select(F.lit(0).alias("image"), (F.col("vec_id") * 8).alias("top"), F.lit(0).alias("left"), F.lit(8).alias("width"), F.transform("score", lambda x: x > 0.1).alias("mask"))
    return components.extents(components.components(tiles)).drop("image")


@query("G12 G4")
def resampled_maps(spark, sf_dir):
    """Range of each map after resampling to 16 x 16, and after a round trip through a padded square."""

    def f(a):
        big = ops.resized(a, 16, 16)
        square, geometry = ops.boxed(a, 12)
        back = ops.unboxed(square, geometry, (0, 0, 8, 8), 8, 8)
        return {"least": round(float(big.min()), 6), "most": round(float(big.max()), 6), "drift": round(float(abs(back - a).max()), 6)}

    return ops.per_image(raster_rows(spark, sf_dir), "vec_id", "score", 8, f, "least double, most double, drift double")


@query("G7 G6", f"""WITH {RASTER}, s AS (SELECT vec_id, CASE WHEN vec_id % 2 = 1 THEN 7 - y ELSE y END AS y, CASE WHEN vec_id % 2 = 1 THEN 7 - x ELSE x END AS x, score FROM px)
SELECT vec_id, round(sum(score * ((y + 1) * 12 + x + 2)), 6) AS moment, round(sum(score * ((y + 1) * 12 + x + 2)), 6) AS common_moment FROM s GROUP BY vec_id""")
def turned_back(spark, sf_dir):
    """Maps put back on a source of 12 x 12, of which every second one was looked at upside down: what lies where, and the
    same at the common size, which is that of the source."""
    weight = np.arange(144.0).reshape(12, 12)

    def f(a):
        vec_id, a = a[0], a[1:].reshape(8, 8)
        square, geometry = ops.boxed(a, 8)
        back = [ops.unboxed(square, geometry, (2, 1, 10, 9), 12, 12, turn=bool(vec_id % 2), common=c) for c in (None, 12)]
        return {n: float((b * weight).sum()) for n, b in zip(("moment", "common_moment"), back)}

    rows = raster_rows(spark, sf_dir).withColumn("score", F.concat(F.array(F.col("vec_id").cast("double")), "score"))
    return six(ops.per_image(rows, "vec_id", "score", 65, lambda a: f(a.ravel()), "moment double, common_moment double"), "moment", "common_moment")


def _photographs(spark, sf_dir):
    """(image, height, width, rgb): three vectors in a row are the red, green and blue planes of an image, whose pixels are
    four by four squares."""
    v = raster_rows(spark, sf_dir).select(F.expr("vec_id div 3").alias("image"), (F.col("vec_id") % 3).alias("plane"), "score")
    planes = v.groupBy("image").agg(*[F.max(F.when(F.col("plane") == i, F.col("score"))).alias(f"p{i}") for i in range(3)]).dropna()
    kind = planes.schema["image"].dataType.simpleString()

    def made(batches):
        for batch in batches:
            for c in range(0, batch.num_rows, IMAGES):
                part = batch.slice(c, IMAGES)
                p = np.stack([part.column(i).flatten().to_numpy(zero_copy_only=False).reshape(-1, 8, 8) for i in (1, 2, 3)], axis=3)
                rgb = p.repeat(4, axis=1).repeat(4, axis=2)
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array([32] * len(rgb), pa.int32())] * 2, _lists(rgb.reshape(len(rgb), -1))], ["image", "height", "width", "rgb"])

    return planes.select("image", *[F.slice(f"p{i}", 1, 64) for i in range(3)]).mapInArrow(made, f"image {kind}, height int, width int, rgb array<double>")


def _lists(rows):
    """A column of arrays of doubles."""
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, rows)]), pa.int32()), pa.array(np.concatenate(rows) if len(rows) else np.zeros(0)))


_PLANES = """p AS (SELECT a.vec_id // 3 AS image, a.embedding AS r, b.embedding AS g, c.embedding AS b FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 JOIN embeddings c ON c.vec_id = a.vec_id + 2 WHERE a.vec_id % 3 = 0),
q AS (SELECT image, y, x, CAST(r[y // 4 * 8 + x // 4 + 1] AS DOUBLE) AS r, CAST(g[y // 4 * 8 + x // 4 + 1] AS DOUBLE) AS g, CAST(b[y // 4 * 8 + x // 4 + 1] AS DOUBLE) AS b FROM p, (SELECT unnest(range(32)) AS y), (SELECT unnest(range(32)) AS x))"""
_BALL = "(SELECT dy, dx FROM (SELECT unnest(range(-3, 4)) AS dy), (SELECT unnest(range(-3, 4)) AS dx) WHERE abs(dy) + abs(dx) <= 3)"


@query("G1 G5", f"""WITH RECURSIVE {_PLANES}, m AS (SELECT image, y, x FROM q WHERE b > r + 0.05 AND g > r + 0.03 AND greatest(r, g, b) - least(r, g, b) > 0.12 * greatest(r, g, b, 1e-6)),
d AS (SELECT DISTINCT image, y + dy AS y, x + dx AS x FROM m, {_BALL} WHERE y + dy BETWEEN 0 AND 31 AND x + dx BETWEEN 0 AND 31),
on_ AS (SELECT image, e.y - dy AS y, e.x - dx AS x FROM d e, {_BALL} GROUP BY 1, 2, 3 HAVING count(*) = 25), {_RUNS.format(0)},
s AS (SELECT image, root, sum(b - a + 1) AS pixels, min(a) AS x0, min(y) AS y0, max(b) + 1 AS x1, max(y) + 1 AS y1 FROM k GROUP BY image, root QUALIFY row_number() OVER (PARTITION BY image ORDER BY sum(b - a + 1) DESC, root) = 1),
t AS (SELECT p.image, coalesce(pixels / 1024, 0.0) AS share, pixels IS NULL AS none, coalesce(pixels / 1024 BETWEEN 0.02 AND 0.65, false) AS ok, x0, y0, x1, y1 FROM p LEFT JOIN s USING (image))
SELECT image, round(share, 6) AS share, CAST(CASE WHEN ok THEN x0 END AS INTEGER) AS x0, CAST(CASE WHEN ok THEN y0 END AS INTEGER) AS y0, CAST(CASE WHEN ok THEN x1 END AS INTEGER) AS x1, CAST(CASE WHEN ok THEN y1 END AS INTEGER) AS y1,
CAST(CASE WHEN ok THEN greatest(0, floor(x0 - 0.08 * (x1 - x0))) ELSE 0 END AS INTEGER) AS "left", CAST(CASE WHEN ok THEN greatest(0, floor(y0 - 0.45 * (y1 - y0))) ELSE 0 END AS INTEGER) AS top,
CAST(CASE WHEN ok THEN least(32, ceil(x1 + 0.08 * (x1 - x0))) ELSE 32 END AS INTEGER) AS "right", CAST(CASE WHEN ok THEN least(32, ceil(y1 + 0.45 * (y1 - y0))) ELSE 32 END AS INTEGER) AS bottom,
CASE WHEN none THEN 'no component' WHEN NOT ok THEN 'share out of bounds' END AS failure,
CASE WHEN NOT ok THEN 'no board' WHEN (x1 - x0) < 1.4 * (y1 - y0) THEN 'not lying' ELSE 'lying' END AS stance FROM t""")
def stored_boards(spark, sf_dir):
    """Boards on stored images: share, box, crop and why there is none; and what of the pose their boxes decide."""
    images = stored(_photographs(spark, sf_dir))
    found = stored(boards.boards(images))
    stance = F.when(F.col("reason").isin("", "ambiguous"), "lying").otherwise(F.col("reason"))
    return six(found.join(boards.poses(images, found).select("image", stance.alias("stance")), "image"), "share")


@query("G3", f"""WITH {_PLANES} SELECT image, round(avg((r - 0.485) / 0.229), 6) AS red, round(avg((g - 0.456) / 0.224), 6) AS green, round(avg((b - 0.406) / 0.225), 6) AS blue FROM q GROUP BY image""")
def tensor_means(spark, sf_dir):
    """Channels of normalised tensors, by their means."""

    def f(a):
        return dict(zip(("red", "green", "blue"), ops.tensor(a.reshape(32, 32, 3)).mean(axis=(1, 2)).tolist()))

    return six(ops.per_image(_photographs(spark, sf_dir), "image", "rgb", 96, f, "red double, green double, blue double"), "red", "green", "blue")


def _grey_grid(a):
    """A crop's grey values on an 8 x 8 grid; of (width, turned, values by rows)."""
    width, turn, values = int(a[0]), bool(a[1]), a[2:]
    grey = values.reshape(-1, width, 3).mean(axis=2)
    return ops.resized(grey[::-1, ::-1] if turn else grey, 8, 8).ravel()


@query("V12 V9")
def inspector(spark, sf_dir):
    """From stored images to decisions: board, crop, pose, features of the upright crop by a registered extractor, distance
    from a frozen memory whose identity is checked first, and the flag."""
    ops.register("grey_grid", lambda a: _grey_grid(a.ravel()))
    images = stored(_photographs(spark, sf_dir))
    found = stored(boards.boards(images))
    seen = images.join(found, "image").join(boards.poses(images, found).select("image", "pose"), "image")
    turned = (F.col("pose") == "reversed_180").cast("int")

    def crops(batches):
        """Width, whether it is turned, and values of each crop."""
        for batch in batches:
            for c in range(0, batch.num_rows, IMAGES):
                part = batch.slice(c, IMAGES)
                rgb = part.column(6).flatten().to_numpy(zero_copy_only=False).reshape(-1, 32, 32, 3)
                boxes = zip(*(part.column(i).to_pylist() for i in range(1, 6)))
                yield pa.RecordBatch.from_arrays([part.column(0), _lists([np.concatenate(([right - left, turn], a[top:bottom, left:right].ravel())) for a, (left, top, right, bottom, turn) in zip(rgb, boxes)])], ["vec_id", "values"])

    kind = seen.schema["image"].dataType.simpleString()
    packed = seen.select("image", "left", "top", "right", "bottom", turned, "rgb").mapInArrow(crops, f"vec_id {kind}, values array<double>")
    rows = ops.features(packed, "vec_id", "values", 1, "grey_grid").withColumnRenamed("features", "embedding")
    rows = stored(rows.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(4))))
    model = knn.fit(rows.where("part > 1"), rows.where("part = 1"), 0.95)
    path = f"{shared_dir(spark)}/veldspar-{uuid.uuid4().hex}"
    knn.save(model, path)
    governance.freeze(spark, f"{path}.json", {"memory": model.memory}, {"q": 0.95})
    frozen = knn.load(spark, path)
    governance.verify(spark, f"{path}.json", {"memory": frozen.memory}, {"q": 0.95})
    return six(knn.inspected(frozen, rows.where("part = 0")), "distance")


@query("G16")
def map_hashes(spark, sf_dir):
    """Difference hash of each map."""
    return ops.per_image(raster_rows(spark, sf_dir), "vec_id", "score", 8, lambda a: {"dhash": ops.difference_hash(a)}, "dhash long")


@query("G17", f"""WITH {RASTER}, s AS (SELECT vec_id, count(*) FILTER (truth) AS before, count(*) FILTER (truth AND y % 2 = 1 AND x % 2 = 1) AS kept FROM px GROUP BY vec_id)
SELECT count(*) AS masks, count(*) FILTER (before > 0 AND kept = 0) AS lost, round(min(kept * 4 / nullif(before, 0)), 6) AS min_ratio, round(max(kept * 4 / nullif(before, 0)), 6) AS max_ratio FROM s""")
def mask_retention(spark, sf_dir):
    s = raster(spark, sf_dir).groupBy("vec_id").agg(F.count_if("truth").alias("before"), F.count_if(F.col("truth") & (F.col("y") % 2 == 1) & (F.col("x") % 2 == 1)).alias("kept"))
    ratio = safe_ratio(F.col("kept") * 4, F.col("before"))
    return six(s.agg(F.count("*").alias("masks"), F.count_if((F.col("before") > 0) & (F.col("kept") == 0)).alias("lost"), F.min(ratio).alias("min_ratio"), F.max(ratio).alias("max_ratio")), "min_ratio", "max_ratio")
