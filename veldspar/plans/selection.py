"""Deterministic selection and windows."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalar import rounded
from ..operators import selection
from ..operators.order import with_quantiles
from ..sources.files import read_table
from .base import PREDICTIONS, predictions, query, six


@query("W3 W15", f"""WITH {PREDICTIONS}, u AS (SELECT user_id, sum(score) AS total FROM pred GROUP BY user_id), s AS (SELECT *, total / sum(total) OVER () AS share FROM u)
SELECT user_id, CAST(row_number() OVER (ORDER BY total DESC, user_id) AS INTEGER) AS rank, round(total, 6) AS total, round(share, 6) AS share FROM s QUALIFY row_number() OVER (ORDER BY total DESC, user_id) <= 10""")
def top_contributors(spark, sf_dir):
    u = predictions(spark, sf_dir).groupBy("user_id").agg(F.sum("score").alias("total"))
    whole = u.agg(F.sum("total").alias("whole"))
    top = selection.top_rows(u, [F.desc("total"), F.col("user_id")], 10).crossJoin(F.broadcast(whole))
    return six(top.select("user_id", "rank", "total", (F.col("total") / F.col("whole")).alias("share")), "total", "share")


@query("W4 W2", f"WITH {PREDICTIONS} SELECT user_id, image_id, score FROM pred QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY score DESC, image_id) = 1")
def first_per_group(spark, sf_dir):
    return selection.best(predictions(spark, sf_dir), ["user_id"], [-F.col("score"), F.col("image_id")], ["image_id", "score"])


@query("W5", f"""WITH {PREDICTIONS}, t AS (
SELECT image_id, 1 AS rule FROM (SELECT image_id FROM pred WHERE label = 1 ORDER BY score DESC, image_id LIMIT 8) UNION ALL SELECT image_id, 2 FROM (SELECT image_id FROM pred ORDER BY score, image_id LIMIT 8) UNION ALL
SELECT image_id, 3 FROM (SELECT image_id FROM pred ORDER BY abs(score - 60), image_id LIMIT 8) UNION ALL SELECT image_id, 4 FROM (SELECT image_id FROM pred ORDER BY score DESC, image_id LIMIT 12)),
a AS (SELECT image_id, min(rule) AS first_rule, list_sort(list(DISTINCT rule)) AS rules FROM t GROUP BY image_id)
SELECT image_id, CAST(row_number() OVER (ORDER BY first_rule, image_id) AS INTEGER) AS place, first_rule, array_to_string(list_filter(rules, lambda r: r <> first_rule), '|') AS additional_rules FROM a
QUALIFY row_number() OVER (ORDER BY first_rule, image_id) <= 24""")
def priority_selection(spark, sf_dir):
    p = predictions(spark, sf_dir)
    tag = lambda df, order, n, rule: df.orderBy(*order, "image_id").limit(n).select("image_id", F.lit(rule).alias("rule"))
    tagged = tag(p.where("label = 1"), [F.desc("score")], 8, 1).union(tag(p, [F.asc("score")], 8, 2)).union(tag(p, [F.abs(F.col("score") - 60)], 8, 3)).union(tag(p, [F.desc("score")], 12, 4))
    return selection.by_priority(tagged, "image_id", "rule", 24)


_PICKS = {"strongest": ("label = 1 AND score > 60", "size DESC, image_id"), "weakest": ("label = 1 AND score > 60", "size, image_id"), "nearest below": ("label = 1 AND NOT score > 60", "score DESC, image_id"), "lowest": ("label = 1 AND NOT score > 60", "score, image_id"), "smallest": ("label = 1", "size, image_id")}


@query("W6", f"""WITH {PREDICTIONS}, t AS (""" + " UNION ALL ".join(f"SELECT image_id, '{name}' AS reason FROM (SELECT image_id FROM pred WHERE {rows} ORDER BY {order} LIMIT 1)" for name, (rows, order) in _PICKS.items()) + """
UNION ALL SELECT image_id, 'middle of ' || kind FROM (SELECT kind, image_id, row_number() OVER (PARTITION BY kind ORDER BY score, image_id) AS i, count(*) OVER (PARTITION BY kind) AS n FROM pred) WHERE i = n // 2 + 1)
SELECT image_id, string_agg(reason, '|' ORDER BY reason) AS reasons FROM t GROUP BY image_id""")
def reasoned_examples(spark, sf_dir):
    """One example for each reason, without a cap; an image that several reasons pick has them all."""
    p = predictions(spark, sf_dir)
    tagged = None
    for name, (rows, order) in _PICKS.items():
        keys = [F.desc(k.split()[0]) if k.endswith(" DESC") else F.asc(k) for k in order.split(", ")]
        one = p.where(rows).orderBy(*keys).limit(1).select("image_id", F.lit(name).alias("reason"))
        tagged = one if tagged is None else tagged.unionByName(one)
    middle = selection.middle_rows(p, ["kind"], "score", "image_id").select("image_id", F.concat(F.lit("middle of "), "kind").alias("reason"))
    return selection.with_reasons(tagged.unionByName(middle), "image_id", "reason")


@query("W7", f"""WITH {PREDICTIONS}, r AS (SELECT kind, image_id, score, row_number() OVER (PARTITION BY kind ORDER BY score, image_id) AS i, count(*) OVER (PARTITION BY kind) AS n FROM pred) SELECT kind, image_id, score FROM r WHERE i = n // 2 + 1""")
def middle_element(spark, sf_dir):
    return selection.middle_rows(predictions(spark, sf_dir), ["kind"], "score", "image_id").select("kind", "image_id", "score")


@query("W8", f"""WITH {PREDICTIONS}, m AS (SELECT kind, quantile_cont(score, 0.5) AS median FROM pred GROUP BY kind)
SELECT kind, image_id, score, round(median, 6) AS median FROM pred JOIN m USING (kind) QUALIFY row_number() OVER (PARTITION BY kind ORDER BY abs(score - median), image_id) = 1""")
def median_nearest_example(spark, sf_dir):
    return six(selection.nearest_to_median(predictions(spark, sf_dir), ["kind"], "score", "image_id"), "median")


@query("W9", f"""WITH {PREDICTIONS}, r AS (SELECT image_id, score, row_number() OVER (ORDER BY score, image_id) - 1 AS place, count(*) OVER () AS n FROM pred), w AS (SELECT DISTINCT CAST(floor((n - 1) * i / 11.0) AS BIGINT) AS place FROM (SELECT DISTINCT n FROM r), (SELECT unnest(range(0, 12)) AS i))
SELECT place, image_id, score FROM r JOIN w USING (place)""")
def systematic_sample(spark, sf_dir):
    p = predictions(spark, sf_dir).select("image_id", "score")
    places = p.agg(F.count("*").alias("n")).select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(11)), lambda i: F.floor((F.col("n") - 1) * i / 11.0).cast("long"))).alias("place")).distinct()
    return selection.at_places(p, ["score", "image_id"], places).select("place", "image_id", "score")


@query("W10", f"""WITH {PREDICTIONS}, u AS (SELECT image_id, 'score' AS metric, score AS v FROM pred UNION ALL SELECT image_id, 'size', size FROM pred),
r AS (SELECT *, row_number() OVER (PARTITION BY metric ORDER BY v, image_id) AS lo, row_number() OVER (PARTITION BY metric ORDER BY v DESC, image_id) AS hi FROM u) SELECT DISTINCT image_id FROM r WHERE lo = 1 OR hi = 1""")
def extremes(spark, sf_dir):
    u = predictions(spark, sf_dir).unpivot(["image_id"], [F.col("score"), F.col("size").cast("double").alias("size")], "metric", "v")
    lo = selection.best(u, ["metric"], [F.col("v"), F.col("image_id")], ["image_id"])
    hi = selection.best(u, ["metric"], [-F.col("v"), F.col("image_id")], ["image_id"])
    return lo.union(hi).select("image_id").distinct()


@query("W13", f"""WITH {PREDICTIONS}, r AS (SELECT user_id, ts - lag(ts) OVER w AS gap, score - lag(score) OVER w AS step FROM pred WINDOW w AS (PARTITION BY user_id ORDER BY image_id))
SELECT user_id, coalesce(bool_and(gap >= INTERVAL 0 SECOND), true) AS monotone, count(*) FILTER (step < 0) AS falls FROM r GROUP BY user_id""")
def monotone_check(spark, sf_dir):
    own = Window.partitionBy("user_id").orderBy("image_id")
    r = predictions(spark, sf_dir).select("user_id", (F.col("ts") >= F.lag("ts").over(own)).alias("up"), (F.col("score") - F.lag("score").over(own)).alias("step"))
    return r.groupBy("user_id").agg(F.coalesce(F.bool_and("up"), F.lit(True)).alias("monotone"), F.count_if(F.col("step") < 0).alias("falls"))


@query("W14", f"WITH {PREDICTIONS} SELECT image_id, user_id, min(score) OVER (PARTITION BY user_id ORDER BY ts, image_id) AS least_so_far FROM pred")
def running_minimum(spark, sf_dir):
    own = Window.partitionBy("user_id").orderBy("ts", "image_id").rowsBetween(Window.unboundedPreceding, 0)
    return predictions(spark, sf_dir).select("image_id", "user_id", F.min("score").over(own).alias("least_so_far"))


@query("V2 F17", """WITH r AS (SELECT vec_id, label, row_number() OVER (ORDER BY sha256('42|' || vec_id)) AS i FROM embeddings) SELECT vec_id, label, i <= 128 AS selected FROM r""")
def uniform_memory(spark, sf_dir):
    v = read_table(spark, sf_dir, "embeddings").select("vec_id", "label")
    chosen = selection.hashed_sample(v, "vec_id", 128).select("vec_id", F.lit(True).alias("selected"))
    return v.join(F.broadcast(chosen), "vec_id", "left").select("vec_id", "label", F.coalesce("selected", F.lit(False)).alias("selected"))


@query("O15 O14", """SELECT o_orderpriority AS phase, count(*) AS runs, round(quantile_cont(o_totalprice, 0.5), 6) AS median_s, round(quantile_cont(o_totalprice, 0.95), 6) AS p95_s,
CAST(epoch(max(o_orderdate)) - epoch(min(o_orderdate)) AS BIGINT) AS span_s FROM orders GROUP BY o_orderpriority""")
def runtime_phases(spark, sf_dir):
    o = read_table(spark, sf_dir, "orders")
    span = F.unix_timestamp(F.max("o_orderdate")) - F.unix_timestamp(F.min("o_orderdate"))
    o = o.withColumnRenamed("o_orderpriority", "phase")
    g = with_quantiles(o.groupBy("phase").agg(F.count("*").alias("runs"), span.alias("span_s")), o, {"o_totalprice": {"median_s": 0.5, "p95_s": 0.95}}, ["phase"])
    return g.withColumns({c: rounded(F.col(c)) for c in ("median_s", "p95_s")})
