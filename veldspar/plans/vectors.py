"""Vector queries: nearest neighbours, memories, coverage, and the flagship detector."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalar import rounded, safe_ratio
from ..functions.vectors import distance, normalised, total
from ..operators import knn, metrics, order, raster
from ..sources.files import read_table
from ..sources.scratch import shared_dir, stored
from .base import query, six

_NEAR = """d AS (SELECT q.vec_id AS query_id, b.vec_id AS bank_id, list_distance(CAST(q.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS distance, b.label AS bank_label
FROM embeddings q, embeddings b WHERE {where})"""


def _vectors(spark, sf_dir):
    return read_table(spark, sf_dir, "embeddings")


def _nearest_other(v, memory):
    """Each vector's nearest one in the memory that isn't itself: of its two nearest, the first other one."""
    both = knn.nearest(v, v.where(memory), 2).where("query_id <> bank_id")
    return both.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).where("place = 1").drop("place", "rank")


@query("J8 R9", "WITH " + _NEAR.format(where="q.vec_id <> b.vec_id AND b.label <> 0") + """ SELECT query_id, bank_id, round(distance, 6) AS distance FROM d QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY distance, bank_id) = 1""")
def nn_score(spark, sf_dir):
    """Every vector against the memory of all other classes than 0, itself left out."""
    return six(_nearest_other(_vectors(spark, sf_dir), "label <> 0").select("query_id", "bank_id", "distance"), "distance")


@query("J9 W13", "WITH " + _NEAR.format(where="b.label <> 9") + """, m AS (SELECT *, min(distance) OVER (PARTITION BY query_id) AS least, row_number() OVER (PARTITION BY query_id ORDER BY distance, bank_id) AS rank FROM d),
t AS (SELECT *, count(*) FILTER (distance = least) OVER (PARTITION BY query_id) AS ties FROM m) SELECT query_id, CAST(rank AS INTEGER) AS rank, bank_id, round(distance, 6) AS distance, ties FROM t WHERE rank <= 5""")
def knn_topk_ties(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return six(knn.nearest(v, v.where("label <> 9"), 5), "distance")


@query("V1 A18", """WITH p AS (SELECT label, i, avg(CAST(embedding[i] AS DOUBLE)) AS c FROM embeddings, (SELECT unnest(range(1, 65)) AS i) WHERE label <> 0 GROUP BY label, i),
m AS (SELECT label, list(c ORDER BY i) AS c FROM p GROUP BY label), n AS (SELECT label, list_transform(c, lambda x: x / sqrt(list_dot_product(c, c))) AS c FROM m)
SELECT v.vec_id, min(round(list_distance(CAST(v.embedding AS DOUBLE[]), n.c), 6)) AS distance FROM embeddings v, n GROUP BY v.vec_id""")
def global_embedding_distance(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    parts = v.where("label <> 0").select("label", F.posexplode(F.col("embedding").cast("array<double>")).alias("i", "x"))
    means = parts.groupBy("label", "i").agg(F.avg("x").alias("c")).groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "c"))).alias("c"))
    centres = means.select(normalised(F.col("c.c")).alias("c"))  # one row per class
    every = v.select("vec_id", "embedding").crossJoin(F.broadcast(centres))
    return every.groupBy("vec_id").agg(F.min(rounded(distance(F.col("embedding"), F.col("c")))).alias("distance"))


@query("V8 A28", "WITH " + _NEAR.format(where="b.label = 1") + """, n AS (SELECT query_id, min(distance) AS distance FROM d GROUP BY query_id)
SELECT count(*) AS n, round(avg(distance), 6) AS mean, round(quantile_cont(distance, 0.5), 6) AS median, round(quantile_cont(distance, 0.95), 6) AS p95, round(max(distance), 6) AS max,
round(avg(CASE WHEN distance = 0 THEN 1.0 ELSE 0.0 END), 6) AS zero_share FROM n""")
def coverage_stats(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    return six(knn.coverage(knn.nearest(v, v.where("label = 1"), 1)), "mean", "median", "p95", "max", "zero_share")


@query("A29 A25", "SELECT count(*) AS n, count(DISTINCT embedding) AS distinct_vectors, count(*) - count(DISTINCT embedding) AS repeated FROM embeddings")
def vector_duplicates(spark, sf_dir):
    v = _vectors(spark, sf_dir).groupBy("embedding").agg(F.count("*").alias("n")).agg(F.sum("n").alias("n"), F.count("*").alias("distinct_vectors"))
    return v.select("n", "distinct_vectors", (F.col("n") - F.col("distinct_vectors")).alias("repeated"))


@query("A16", "WITH " + _NEAR.format(where="q.vec_id <> b.vec_id AND b.label <> 0") + """, w AS (SELECT bank_label FROM d QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY distance, bank_id) = 1)
SELECT l.label, count(w.bank_label) AS references FROM (SELECT DISTINCT label FROM embeddings) l LEFT JOIN w ON w.bank_label = l.label GROUP BY l.label""")
def references_per_class(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    near = _nearest_other(v, "label <> 0").join(v.select(F.col("vec_id").alias("bank_id"), "label"), "bank_id")
    counts = near.groupBy("label").agg(F.count("*").alias("references"))
    return v.select("label").distinct().join(counts, "label", "left").fillna(0, ["references"])


@query("V11 F12", "WITH " + _NEAR.format(where="b.label <> 2") + """, k AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY distance, bank_id) <= 5),
o AS (SELECT query_id, sqrt(power((query_id // 8 % 8 - bank_id // 8 % 8) / 8.0, 2) + power((query_id % 8 - bank_id % 8) / 8.0, 2)) / sqrt(2) AS shift FROM k)
SELECT query_id, count(*) AS pairs, round(min(shift), 6) AS least, round(quantile_cont(shift, 0.5), 6) AS median, count(*) FILTER (shift <= 0.05) AS within_05, count(*) FILTER (shift <= 0.2) AS within_20 FROM o GROUP BY query_id""")
def neighbour_displacement(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    k = knn.nearest(v, v.where("label <> 2"), 5)
    row, col = (lambda c: F.expr(f"{c} div 8 % 8")), (lambda c: F.col(c) % 8)
    shift = F.sqrt(F.pow((row("query_id") - row("bank_id")) / 8.0, 2) + F.pow((col("query_id") - col("bank_id")) / 8.0, 2)) / F.sqrt(F.lit(2.0))
    g = k.withColumn("s", shift).groupBy("query_id").agg(F.count("*").alias("pairs"), F.min("s").alias("least"), F.percentile("s", F.lit(0.5)).alias("median"), F.count_if(F.col("s") <= 0.05).alias("within_05"), F.count_if(F.col("s") <= 0.2).alias("within_20"))
    return six(g, "least", "median")


@query("V3")
def gaussian_projection(spark, sf_dir):
    """Lengths before and after a seeded random projection to 16 dimensions."""
    v = _vectors(spark, sf_dir)
    p = knn.projected(v.select("vec_id", "embedding"), knn.projection(64, 16))
    norm = lambda c: F.sqrt(total(F.transform(F.col(c).cast("array<double>"), lambda x: x * x)))
    return p.select("vec_id", rounded(norm("embedding")).alias("length"), rounded(norm("projected")).alias("projected_length"))


@query("V5 V3")
def coreset_vectors(spark, sf_dir):
    """24 centres selected among projected vectors, and their full vectors in order of selection, told by their digests."""
    v = _vectors(spark, sf_dir)
    projected = knn.projected(v.select("vec_id", "embedding"), knn.projection(64, 16)).select("vec_id", "projected")
    full = knn.recovered(knn.greedy_coreset(projected, 24, vector="projected"), v)
    return six(full.select("selection_order", "vec_id", "label", F.sha2(F.to_json("embedding"), 256).alias("vector_sha256"), "distance"), "distance")


@query("V4 W14")
def greedy_coreset(spark, sf_dir):
    """24 centres by farthest-point selection, with the vectors' labels, in order of selection."""
    v = _vectors(spark, sf_dir)
    chosen = knn.greedy_coreset(v.select("vec_id", "embedding"), 24)
    met = F.broadcast(chosen).join(v.select(F.col("vec_id").alias("id"), "label"), "id")
    return six(met.select("selection_order", F.col("id").alias("vec_id"), "label", "distance"), "distance")


_SPLIT = """e AS (SELECT *, CASE WHEN label = 9 THEN 'test' WHEN sha256('s|' || vec_id) < '3' THEN 'calibration' ELSE 'fit' END AS split FROM embeddings)"""


def _detector(spark, sf_dir):
    """(vec_id, split, distance, threshold, flagged): a memory of normal vectors, calibrated on normal vectors."""
    e = _vectors(spark, sf_dir).withColumn("split", _split())
    near = knn.nearest(e.where("split <> 'fit'"), e.where("split = 'fit'"), 1).select(F.col("query_id").alias("vec_id"), "distance")
    scored = stored(e.select("vec_id", "split").join(near, "vec_id"))
    t = order.higher_quantile(scored.where("split = 'calibration'"), "distance", 0.95).select("threshold")
    return metrics.flagged(scored, "distance", t)


@query("V1 J8 Q1 F1 A20", "WITH " + _SPLIT + """, n AS (SELECT q.vec_id, q.split, min(list_distance(CAST(q.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))) AS d FROM e q, e b WHERE q.split <> 'fit' AND b.split = 'fit' GROUP BY q.vec_id, q.split),
t AS (SELECT d AS threshold FROM (SELECT d, row_number() OVER (ORDER BY d) AS i, count(*) OVER () AS m FROM n WHERE split = 'calibration') WHERE i = CAST(ceil(0.95 * (m - 1)) AS BIGINT) + 1)
SELECT split, count(*) AS n, count(*) FILTER (d > threshold + 1e-12) AS flagged, round(max(threshold), 6) AS threshold, round(max(d), 6) AS max_score, round(count(*) FILTER (d > threshold + 1e-12) / count(*), 6) AS rate FROM n, t GROUP BY split""")
def detector(spark, sf_dir):
    """The flagship: memory, scores, calibrated threshold, strict flags and rates, from vectors to a report."""
    g = _detector(spark, sf_dir).groupBy("split").agg(F.count("*").alias("n"), F.count_if("flagged").alias("flagged"), F.max("threshold").alias("threshold"), F.max("distance").alias("max_score"))
    return six(g.withColumn("rate", safe_ratio(F.col("flagged"), F.col("n"))), "threshold", "max_score", "rate")


def _split():
    return F.when(F.col("label") == 9, "test").when(F.sha2(F.concat(F.lit("s|"), F.col("vec_id").cast("string")), 256) < "3", "calibration").otherwise("fit")


@query("K6", "WITH " + _SPLIT + """, n AS (SELECT q.vec_id, q.split, min(list_distance(CAST(q.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))) AS d FROM e q, e b WHERE q.split <> 'fit' AND b.split = 'fit' GROUP BY q.vec_id, q.split),
t AS (SELECT d AS threshold FROM (SELECT d, row_number() OVER (ORDER BY d) AS i, count(*) OVER () AS m FROM n WHERE split = 'calibration') WHERE i = CAST(ceil(0.95 * (m - 1)) AS BIGINT) + 1)
SELECT vec_id, round(d, 6) AS distance, d > threshold + 1e-12 AS flagged FROM n, t""")
def detector_model(spark, sf_dir):
    """A model saved (memory and threshold), read again and applied."""
    e = _vectors(spark, sf_dir).withColumn("split", _split())
    fitted = knn.fit(e.where("split = 'fit'"), e.where("split = 'calibration'"), 0.95)
    path = f"{shared_dir(spark)}/veldspar-{uuid.uuid4().hex}"
    knn.save(fitted, path)
    return six(knn.inspected(knn.load(spark, path), e.where("split <> 'fit'")).select("vec_id", "distance", "flagged"), "distance")


_IMAGES = "WITH " + _NEAR.format(where="q.label <> 9 AND b.label = 9") + """, w AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY distance, bank_id) = 1),
p AS (SELECT query_id // 16 AS image_id, query_id % 16 AS patch, bank_id, distance FROM w)"""


@query("V6 V10", _IMAGES + """ SELECT image_id, patch, patch // 4 AS "row", patch % 4 AS "column", bank_id, bank_id // 4 % 4 AS reference_row, bank_id % 4 AS reference_column, round(distance, 6) AS score FROM p
QUALIFY row_number() OVER (PARTITION BY image_id ORDER BY distance DESC, patch) = 1""")
def image_scores(spark, sf_dir):
    """Sixteen vectors in a row are an image of 4 x 4 patches: its score is the farthest patch's distance from the memory,
    with that patch and its nearest reference."""
    return six(knn.image_scores(_patches(spark, sf_dir), 4, 4), "score")


def _patches(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    near = knn.nearest(v.where("label <> 9"), v.where("label = 9"), 1)
    return near.select(F.expr("query_id div 16").alias("image_id"), (F.col("query_id") % 16).alias("patch"), "bank_id", "distance")


@query("V6")
def image_maps(spark, sf_dir):
    """Each image's map: distances of its patches, resampled to 16 x 16 (its sum and greatest value), absent patches 0."""
    return six(knn.image_maps(_patches(spark, sf_dir), 4, 4, 16), "total", "most")


@query("V7 G14", """WITH c AS (SELECT p_partkey, p_size + 20 AS h, CAST(p_retailprice AS BIGINT) % 400 + 30 AS w, p_partkey % 8 AS r, p_partkey // 8 % 8 AS c FROM part),
g AS (SELECT *, greatest(1, CAST(round_even(h * (64 / greatest(h, w)), 0) AS INTEGER)) AS ch, greatest(1, CAST(round_even(w * (64 / greatest(h, w)), 0) AS INTEGER)) AS cw FROM c),
n AS (SELECT *, ((c + 0.5) * 8 - floor((64 - cw) / 2)) / cw AS nx, ((r + 0.5) * 8 - floor((64 - ch) / 2)) / ch AS ny FROM g)
SELECT p_partkey, round(nx, 6) AS nx, round(ny, 6) AS ny, round(5 + nx * w, 6) AS source_x, round(7 + ny * h, 6) AS source_y, NOT (nx >= 0 AND nx < 1 AND ny >= 0 AND ny < 1) AS padding,
CASE WHEN nx >= 0 AND nx < 1 AND ny >= 0 AND ny < 1 THEN 'row' || least(2, CAST(floor(ny * 3) AS INTEGER)) || '_col' || least(2, CAST(floor(nx * 3) AS INTEGER)) ELSE 'padding_center' END AS region FROM n""")
def cell_centres(spark, sf_dir):
    """Where the centre of a cell of 8 pixels lies in the crop (whose corner is at 5, 7) and whether that is padding."""
    p = read_table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") + 20).alias("h"), (F.bround("p_retailprice").cast("long") % 400 + 30).alias("w"), (F.col("p_partkey") % 8).alias("r"), F.expr("p_partkey div 8 % 8").alias("c"))
    at = raster.cell_centre(F.col("r"), F.col("c"), raster.letterbox(F.col("h"), F.col("w"), 64), F.lit(5), F.lit(7), F.col("h"), F.col("w"))
    return six(p.select("p_partkey", at.alias("at")).select("p_partkey", "at.nx", "at.ny", "at.source_x", "at.source_y", "at.padding", "at.region"), "nx", "ny", "source_x", "source_y")


@query("A14", "WITH " + _NEAR.format(where="q.label <> 9 AND b.label = 9") + """, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, bank_id) AS rank FROM d), t AS (SELECT * FROM r WHERE rank <= 3),
s AS (SELECT query_id % 7 AS grp, query_id, rank, distance, greatest(abs(query_id // 8 % 8 - bank_id // 8 % 8), abs(query_id % 8 - bank_id % 8)) / 8.0 AS shift FROM t)
SELECT grp, count(DISTINCT query_id) AS queries, count(*) AS pairs, round(quantile_cont(distance, 0.5), 6) AS median_distance, round(quantile_cont(CASE WHEN rank = 1 THEN distance END, 0.5), 6) AS median_score, round(quantile_cont(shift, 0.5), 6) AS median_shift,
min(shift) AS least_shift, round(quantile_cont(CASE WHEN rank = 1 THEN shift END, 0.5), 6) AS top1_median_shift, round(avg(CASE WHEN shift <= 0.1 THEN 1.0 ELSE 0.0 END), 6) AS within_10, round(avg(CASE WHEN shift <= 0.3 THEN 1.0 ELSE 0.0 END), 6) AS within_30 FROM s GROUP BY grp""")
def trace_summary(spark, sf_dir):
    """Of groups of queries and their three nearest references: distances, shifts, those of the nearest alone, and the
    shares within some radii."""
    v = _vectors(spark, sf_dir)
    t = knn.nearest(v.where("label <> 9"), v.where("label = 9"), 3)
    apart = lambda n: F.abs(F.expr(f"query_id div {n} % 8") - F.expr(f"bank_id div {n} % 8"))
    s = t.withColumns({"grp": F.col("query_id") % 7, "shift": F.greatest(apart(8), apart(1)) / 8.0})
    s = stored(s.withColumns({f"top_{c}": F.when(F.col("rank") == 1, F.col(c)) for c in ("distance", "shift")}))
    near = lambda r: F.avg((F.col("shift") <= r).cast("double"))
    g = s.groupBy("grp").agg(F.countDistinct("query_id").alias("queries"), F.count("*").alias("pairs"), F.min("shift").alias("least_shift"), near(0.1).alias("within_10"), near(0.3).alias("within_30"))
    named = {"distance": {"median_distance": 0.5}, "top_distance": {"median_score": 0.5}, "shift": {"median_shift": 0.5}, "top_shift": {"top1_median_shift": 0.5}}
    return six(order.with_quantiles(g, s, named, ["grp"]), "median_distance", "median_score", "median_shift", "top1_median_shift", "within_10", "within_30")


@query("O8", "WITH " + _SPLIT + """, n AS (SELECT q.vec_id, q.split, min(list_distance(CAST(q.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))) AS d FROM e q, e b WHERE q.split <> 'fit' AND b.split = 'fit' GROUP BY q.vec_id, q.split),
t AS (SELECT d AS threshold FROM (SELECT d, row_number() OVER (ORDER BY d) AS i, count(*) OVER () AS m FROM n WHERE split = 'calibration') WHERE i = CAST(ceil(0.95 * (m - 1)) AS BIGINT) + 1),
s AS (SELECT max(threshold) AS threshold, CAST(count(*) FILTER (d > threshold + 1e-12) AS DOUBLE) AS flagged, max(d) AS max_score, CAST(count(*) AS DOUBLE) AS n FROM n, t)
SELECT metric, round(value, 6) AS first, round(value, 6) AS second FROM s UNPIVOT (value FOR metric IN (threshold, flagged, max_score, n))""")
def independent_review(spark, sf_dir):
    """The detector's figures, and the same by another path: another index (cells and blocks of other sizes), distances as
    SQL expressions of the pairs found, and the threshold by its place in a global order. Both must agree."""
    scored = _detector(spark, sf_dir).agg(F.max("threshold").alias("threshold"), F.count_if("flagged").cast("double").alias("flagged"), F.max("distance").alias("max_score"), F.count("*").cast("double").alias("n"))
    e = _vectors(spark, sf_dir).withColumn("split", _split())
    index = knn.indexed(e.where("split = 'fit'"), 2, block=100, cell_rows=60)
    pairs = knn.nearest(e.where("split <> 'fit'"), index, 2).select("query_id", "bank_id")
    named = e.select(F.col("vec_id").alias("query_id"), "split", F.col("embedding").alias("x")).join(pairs, "query_id").join(e.select(F.col("vec_id").alias("bank_id"), F.col("embedding").alias("y")), "bank_id")
    d = stored(named.groupBy("query_id").agg(F.first("split").alias("split"), F.min(distance(F.col("x"), F.col("y"))).alias("d")))
    own = d.where("split = 'calibration'").select("d")
    place = math.ceil(0.95 * (own.count() - 1))
    threshold = own.orderBy("d").offset(place).limit(1).select(F.col("d").alias("threshold"))
    again = d.crossJoin(F.broadcast(threshold)).agg(F.max("threshold").alias("threshold"), F.count_if(F.col("d") > F.col("threshold") + 1e-12).cast("double").alias("flagged"), F.max("d").alias("max_score"), F.count("*").cast("double").alias("n"))
    long = lambda df, name: df.unpivot([], ["threshold", "flagged", "max_score", "n"], "metric", name)
    return six(long(scored, "first").join(long(again, "second"), "metric"), "first", "second")
