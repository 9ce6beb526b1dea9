"""Strata, several labels per row, paired recipes and reshaping."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalar import chebyshev, labels_of, rounded, safe_ratio
from ..operators import strata
from ..operators.order import with_quantiles
from .base import PREDICTIONS, predictions, query, six

_EDGES = f"""WITH {PREDICTIONS}, s AS (SELECT size, row_number() OVER (ORDER BY size) - 1 AS i, count(*) OVER () AS n FROM pred WHERE size IS NOT NULL),
e AS (SELECT max(size) FILTER (i = CAST(ceil(0.25 * (n - 1)) AS BIGINT)) AS e1, max(size) FILTER (i = CAST(ceil(0.5 * (n - 1)) AS BIGINT)) AS e2, max(size) FILTER (i = CAST(ceil(0.75 * (n - 1)) AS BIGINT)) AS e3 FROM s),
q AS (SELECT pred.*, CASE WHEN size IS NULL THEN NULL WHEN size <= e1 THEN 'Q1' WHEN size <= e2 THEN 'Q2' WHEN size <= e3 THEN 'Q3' ELSE 'Q4' END AS size_quartile FROM pred, e)"""


@query("Q3", _EDGES + " SELECT image_id, size_quartile FROM q")
def size_quartiles(spark, sf_dir):
    p = predictions(spark, sf_dir).withColumn("size", F.col("size").cast("double"))
    return strata.size_quartiles(p, "size").select("image_id", "size_quartile")


@query("Q4", f"WITH {PREDICTIONS} SELECT image_id, CASE WHEN size IS NULL THEN NULL WHEN size <= 20 THEN 'R1' WHEN size <= 45 THEN 'R2' WHEN size <= 70 THEN 'R3' ELSE 'R4' END AS band FROM pred")
def reference_bands(spark, sf_dir):
    band = strata.band(F.col("size"), [F.lit(20), F.lit(45), F.lit(70)], ["R1", "R2", "R3", "R4"])
    return predictions(spark, sf_dir).select("image_id", band.alias("band"))


@query("A3 A8 J14", _EDGES + """, g AS (SELECT kind, size_quartile, count(*) AS n, count(*) FILTER (score > 60) AS detected, count(*) FILTER (NOT score > 60) AS missed, CAST(min(size) AS DOUBLE) AS min_size, CAST(max(size) AS DOUBLE) AS max_size,
quantile_cont(size, 0.5) AS median_size, quantile_cont(score, 0.5) AS median_score, quantile_cont(score - 60, 0.5) AS median_margin FROM q GROUP BY kind, size_quartile),
d AS (SELECT k.kind, b.size_quartile FROM (SELECT DISTINCT kind FROM pred UNION SELECT 'none') k, (SELECT unnest(['Q1', 'Q2', 'Q3', 'Q4']) AS size_quartile) b)
SELECT d.kind, d.size_quartile, coalesce(n, 0) AS n, coalesce(detected, 0) AS detected, coalesce(missed, 0) AS missed, round(detected / nullif(n, 0), 6) AS recall, min_size, max_size,
round(median_size, 6) AS median_size, round(median_score, 6) AS median_score, round(median_margin, 6) AS median_margin FROM d LEFT JOIN g USING (kind, size_quartile)""")
def group_summary_keep_empty(spark, sf_dir):
    p = predictions(spark, sf_dir).withColumns({"v": F.col("size").cast("double"), "flag": F.col("score") > 60, "margin": F.col("score") - 60})
    g = strata.summary(strata.size_quartiles(p, "v"), ["kind", "size_quartile"], "flag", "v", "score", "margin")
    kinds = p.select("kind").union(spark.createDataFrame([("none",)], "kind string")).distinct()
    dimension = kinds.withColumn("size_quartile", F.explode(F.array(*[F.lit(f"Q{i}") for i in (1, 2, 3, 4)])))
    out = strata.keep_groups(dimension, g, ["kind", "size_quartile"], ["n", "detected", "missed"])
    return six(out, "recall", "median_size", "median_score", "median_margin")


@query("A4", f"""WITH {PREDICTIONS} SELECT kind, count(score) AS count, round(quantile_cont(score, 0.5), 6) AS median, round(quantile_cont(score, 0.25), 6) AS p25, round(quantile_cont(score, 0.75), 6) AS p75,
min(score) AS min, max(score) AS max FROM pred GROUP BY kind""")
def type_distribution(spark, sf_dir):
    return six(strata.spread(predictions(spark, sf_dir), ["kind"], {"score": ""}), "median", "p25", "p75")


_LABELS = "list_filter([CASE WHEN size < 30 THEN 'small' END, CASE WHEN score > 90 THEN 'bright' END, CASE WHEN grp IN (1, 2) THEN 'left' END], lambda v: v IS NOT NULL)"


def _labels():
    return strata.members((F.col("size") < 30, "small"), (F.col("score") > 90, "bright"), (F.col("grp").isin(1, 2), "left"))


@query("R5 A7 A13", f"""WITH {PREDICTIONS}, l AS (SELECT *, unnest({_LABELS}) AS type FROM pred)
SELECT type, count(*) AS n, count(*) FILTER (score > 60) AS detected, round(avg(CASE WHEN score > 60 THEN 1.0 ELSE 0.0 END), 6) AS recall, round(quantile_cont(score, 0.5), 6) AS median_score FROM l GROUP BY type""")
def multilabel_recall(spark, sf_dir):
    rows = strata.per_label(predictions(spark, sf_dir).withColumn("labels", _labels()), "labels", "type")
    g = rows.groupBy("type").agg(F.count("*").alias("n"), F.count_if(F.col("score") > 60).alias("detected"), F.avg((F.col("score") > 60).cast("double")).alias("recall"))
    return six(with_quantiles(g, rows, {"score": {"median_score": 0.5}}, ["type"]), "recall", "median_score")


@query("A27 R10", f"""WITH {PREDICTIONS}, l AS (SELECT grp, {_LABELS} AS labels FROM pred) SELECT grp, CAST(sum(len(labels)) AS BIGINT) AS memberships, count(*) FILTER (list_contains(labels, 'small')) AS with_small FROM l GROUP BY grp""")
def label_memberships(spark, sf_dir):
    p = predictions(spark, sf_dir).select("grp", F.from_json(F.to_json(_labels()), "array<string>").alias("labels"))
    return p.groupBy("grp").agg(F.sum(F.size("labels")).alias("memberships"), F.count_if(F.array_contains("labels", "small")).alias("with_small"))


@query("R6", """WITH t AS (SELECT p_partkey, string_split(replace(p_name, ' ', ' , '), ',') AS raw FROM part), u AS (SELECT p_partkey, list_transform(raw, lambda v: trim(v)) AS labels FROM t)
SELECT p_partkey, CASE WHEN list_contains(labels, '') OR list_contains(labels, 'normal') OR len(list_distinct(labels)) < len(labels) THEN NULL ELSE array_to_string(labels, '+') END AS labels FROM u""")
def label_parse(spark, sf_dir):
    from ..sources.files import read_table

    part = read_table(spark, sf_dir, "part")
    return part.select("p_partkey", F.array_join(labels_of(F.replace("p_name", F.lit(" "), F.lit(" , "))), "+").alias("labels"))


@query("A9 W16", f"""WITH {PREDICTIONS}, o AS (SELECT CASE WHEN grp = 6 THEN NULL ELSE 'g' || grp END AS grp, greatest(abs(size % 10 - user_id % 10), abs(size // 10 - CAST(score AS BIGINT) % 10)) AS offset_cells FROM pred)
SELECT grp, count(*) AS n, round(quantile_cont(offset_cells, 0.5), 6) AS median, round(quantile_cont(offset_cells, 0.9), 6) AS p90, count(*) FILTER (offset_cells <= 1) AS within_1, count(*) FILTER (offset_cells <= 3) AS within_3,
round(avg(CASE WHEN offset_cells <= 3 THEN 1.0 ELSE 0.0 END), 6) AS rate_3 FROM o GROUP BY grp""")
def trace_offset_summary(spark, sf_dir):
    p = predictions(spark, sf_dir)
    d = chebyshev(F.col("size") % 10 - F.col("user_id") % 10, F.expr("size div 10") - F.bround("score").cast("long") % 10)
    o = p.select(F.when(F.col("grp") != 6, F.concat(F.lit("g"), F.col("grp").cast("string"))).alias("grp"), d.alias("d"))
    g = o.groupBy("grp").agg(
        F.count("*").alias("n"), F.count_if(F.col("d") <= 1).alias("within_1"), F.count_if(F.col("d") <= 3).alias("within_3"),
        F.avg((F.col("d") <= 3).cast("double")).alias("rate_3"),
    )
    return six(with_quantiles(g, o, {"d": {"median": 0.5, "p90": 0.9}}, ["grp"]), "median", "p90", "rate_3")


@query("A10 A11", f"""WITH {PREDICTIONS}, g AS (SELECT kind, grp, count(*) AS n, avg(CASE WHEN score > 60 THEN 1.0 ELSE 0.0 END) AS rate, quantile_cont(score, 0.5) AS med, quantile_cont(score, 0.25) AS q25, quantile_cont(score, 0.75) AS q75,
max(score) AS hi, sum(CASE WHEN label = 0 AND score > 60 THEN size ELSE 0 END) AS burden FROM pred GROUP BY kind, grp)
SELECT kind, grp, n, round(rate, 6) AS rate, round(med, 6) AS median, round(q25, 6) AS q25, round(q75, 6) AS q75, hi AS max, CAST(burden AS BIGINT) AS burden, round(burden / nullif(sum(burden) OVER (), 0), 6) AS burden_share FROM g""")
def pose_summary(spark, sf_dir):
    from pyspark.sql.window import Window

    p = predictions(spark, sf_dir)
    wrong = F.when((F.col("label") == 0) & (F.col("score") > 60), F.col("size")).otherwise(0)
    g = p.groupBy("kind", "grp").agg(
        F.count("*").alias("n"), F.avg((F.col("score") > 60).cast("double")).alias("rate"), F.max("score").alias("max"), F.sum(wrong).alias("burden"),
    )
    g = with_quantiles(g, p, {"score": {"median": 0.5, "q25": 0.25, "q75": 0.75}}, ["kind", "grp"])
    return six(g.withColumn("burden_share", safe_ratio(F.col("burden"), F.sum("burden").over(Window.partitionBy()))), "rate", "median", "q25", "q75", "burden_share")


@query("A15", f"""WITH {PREDICTIONS}, u AS (SELECT kind, user_id, count(*) AS pairs, quantile_cont(score, 0.5) AS med, min(score) AS lo FROM pred GROUP BY kind, user_id)
SELECT kind, count(*) AS images, CAST(sum(pairs) AS BIGINT) AS pairs, round(quantile_cont(med, 0.5), 6) AS median_of_medians, min(med) AS min_median, max(med) AS max_median, round(avg(lo), 6) AS mean_min FROM u GROUP BY kind""")
def image_weighted_summary(spark, sf_dir):
    p = predictions(spark, sf_dir)
    u = with_quantiles(p.groupBy("kind", "user_id").agg(F.count("*").alias("pairs"), F.min("score").alias("lo")), p, {"score": {"med": 0.5}}, ["kind", "user_id"])
    g = u.groupBy("kind").agg(F.count("*").alias("images"), F.sum("pairs").alias("pairs"), F.min("med").alias("min_median"), F.max("med").alias("max_median"), F.avg("lo").alias("mean_min"))
    return six(with_quantiles(g, u, {"med": {"median_of_medians": 0.5}}, ["kind"]), "median_of_medians", "mean_min")


@query("A19 A6 O13", f"""WITH {PREDICTIONS}, u AS (SELECT kind, 'score' AS metric, score AS v FROM pred UNION ALL SELECT kind, 'size', size FROM pred)
SELECT kind, metric, min(v) AS min, round(quantile_cont(v, 0.5), 6) AS median, max(v) AS max FROM u GROUP BY kind, metric""")
def statistic_map(spark, sf_dir):
    long = strata.unpivoted(predictions(spark, sf_dir), ["kind"], ["score", "size"], "metric", "v")
    g = long.groupBy("kind", "metric").agg(F.min("v").alias("min"), F.max("v").alias("max"))
    return six(with_quantiles(g, long, {"v": {"median": 0.5}}, ["kind", "metric"]), "median")


_PAIR = f"""WITH {PREDICTIONS}, r AS (SELECT image_id, score AS d1, score * 0.9 + size * 0.2 AS d2, size / 100.0 AS ap1, (size * 7 % 100) / 100.0 AS ap2 FROM pred)"""


@query("J6 J15 Q13 Q14 R8", _PAIR + """ SELECT image_id, CASE WHEN NOT d1 > 60 AND NOT d2 > 60 THEN 'M1' WHEN NOT d1 > 60 THEN 'M2' WHEN d2 > 60 THEN 'M3' ELSE 'M4' END AS outcome_group, round(d2 - d1, 6) AS delta,
(NOT d1 > 60 AND d2 > 60) OR ap2 - ap1 >= 0.1 AS d2_gains, (d1 > 60 AND NOT d2 > 60) OR ap1 - ap2 >= 0.1 AS d1_gains FROM r""")
def recipe_pair_contrast(spark, sf_dir):
    p = predictions(spark, sf_dir)
    one = p.select("image_id", F.lit("d1").alias("recipe"), F.col("score").alias("s"), (F.col("size") / 100.0).alias("ap"))
    # a fifth of a whole number as the SQL's decimals have it, so that a sum of 60 isn't taken for more
    two = p.select("image_id", F.lit("d2"), (F.col("score") * 0.9 + F.col("size") * 2 / 10).alias("s"), ((F.col("size") * 7 % 100) / 100.0).alias("ap"))
    m = strata.paired(one.union(two), "image_id", "recipe", ["d1", "d2"], ["s", "ap"])
    a, b = F.col("s_d1") > 60, F.col("s_d2") > 60
    gain = F.col("ap_d2") - F.col("ap_d1")
    return m.select("image_id", strata.outcome_pair(a, b).alias("outcome_group"), rounded(F.col("s_d2") - F.col("s_d1")).alias("delta"), ((~a & b) | (gain >= 0.1)).alias("d2_gains"), ((a & ~b) | (-gain >= 0.1)).alias("d1_gains"))


@query("J7 R7", f"""WITH {PREDICTIONS}, g AS (SELECT grp, avg(score) FILTER (label = 1) AS r1, avg(score) FILTER (label = 0) AS r0, avg(size) FILTER (label = 1) AS s1, avg(size) FILTER (label = 0) AS s0 FROM pred GROUP BY grp)
SELECT grp, 'score' AS metric, round(r0, 6) AS control, round(r1, 6) AS revised, round(r1 - r0, 6) AS delta FROM g UNION ALL SELECT grp, 'size', round(s0, 6), round(s1, 6), round(s1 - s0, 6) FROM g""")
def unpivot_deltas(spark, sf_dir):
    p = strata.unpivoted(predictions(spark, sf_dir), ["grp", "label"], ["score", "size"])
    g = p.groupBy("grp", "metric").agg(F.avg(F.when(F.col("label") == 0, F.col("value"))).alias("control"), F.avg(F.when(F.col("label") == 1, F.col("value"))).alias("revised"))
    return six(g.withColumn("delta", F.col("revised") - F.col("control")), "control", "revised", "delta")


@query("R8 R9 F13", f"""WITH {PREDICTIONS} SELECT grp, count(*) FILTER (kind = 'click') AS touch, count(*) FILTER (kind = 'view') AS look, count(*) FILTER (kind NOT IN ('click', 'view')) AS other, 'v1' AS recipe FROM pred GROUP BY grp""")
def remapped_pivot(spark, sf_dir):
    p = predictions(spark, sf_dir).withColumn("kind", F.when(F.col("kind") == "click", "touch").when(F.col("kind") == "view", "look").otherwise("other"))
    return p.groupBy("grp").pivot("kind", ["touch", "look", "other"]).agg(F.count("grp")).fillna(0).withColumn("recipe", F.lit("v1"))


@query("F16 F13", f"WITH {PREDICTIONS} SELECT image_id, CAST(CASE WHEN label = 1 THEN size END AS DOUBLE) AS area, CASE WHEN label = 1 THEN CASE WHEN score > 60 THEN 'yes' ELSE 'no' END END AS detected FROM pred")
def null_inapplicable(spark, sf_dir):
    is_one = F.col("label") == 1
    return predictions(spark, sf_dir).select("image_id", F.when(is_one, F.col("size").cast("double")).alias("area"), F.when(is_one, F.when(F.col("score") > 60, "yes").otherwise("no")).alias("detected"))
