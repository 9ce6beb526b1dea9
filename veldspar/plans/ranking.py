"""Thresholds, ranking metrics and distributions."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.scalar import outcome, piped, rounded, safe_ratio, strictly_above
from ..operators import metrics, order
from .base import PREDICTIONS, predictions, query, six

_CUM = f"""WITH {PREDICTIONS}, g AS (SELECT score, sum(label) AS pos, sum(1 - label) AS neg FROM pred GROUP BY score),
c AS (SELECT *, sum(pos) OVER w AS cp, sum(neg) OVER w AS cn, sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM g WINDOW w AS (ORDER BY score DESC))"""


@query("Q1", f"""WITH {PREDICTIONS}, r AS (SELECT kind, score, row_number() OVER (PARTITION BY kind ORDER BY score) AS i, count(*) OVER (PARTITION BY kind) AS n FROM pred)
SELECT kind, score AS threshold, n FROM r WHERE i = CAST(ceil(0.95 * (n - 1)) AS BIGINT) + 1""")
def higher_quantile_threshold(spark, sf_dir):
    return order.higher_quantile(predictions(spark, sf_dir), "score", 0.95, ["kind"])


@query("Q2 A5 A6 A28", f"""WITH {PREDICTIONS} SELECT kind, count(*) AS n, round(avg(score), 6) AS mean, round(quantile_cont(score, 0.5), 6) AS median,
round(stddev_samp(score), 6) AS std, round(quantile_cont(score, 0.9), 6) AS p90, round(quantile_cont(score, 0.95), 6) AS p95, round(quantile_cont(score, 0.99), 6) AS p99,
round(avg(CASE WHEN score > 100 THEN 1.0 ELSE 0.0 END), 6) AS share_above FROM pred WHERE label = 0 GROUP BY kind""")
def normal_distribution(spark, sf_dir):
    p = predictions(spark, sf_dir).where("label = 0")
    sums = p.groupBy("kind").agg(F.count("*").alias("n"), F.avg("score").alias("mean"), F.stddev_samp("score").alias("std"), F.avg((F.col("score") > 100).cast("double")).alias("share_above"))
    out = order.with_quantiles(sums, p, {"score": {"median": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}}, ["kind"])
    return six(out, "mean", "median", "std", "p90", "p95", "p99", "share_above")


@query("F1 F2 F3", f"""WITH {PREDICTIONS}, t AS (SELECT score AS threshold FROM (SELECT score, row_number() OVER (ORDER BY score) AS i, count(*) OVER () AS n FROM pred WHERE label = 0)
WHERE i = CAST(ceil(0.95 * (n - 1)) AS BIGINT) + 1)
SELECT image_id, CASE WHEN label = 1 AND score > threshold THEN 'TP' WHEN label = 1 THEN 'FN' WHEN score > threshold THEN 'FP' ELSE 'TN' END AS outcome,
round(score - threshold, 6) AS margin, round(score / nullif(threshold, 0), 6) AS ratio FROM pred, t""")
def strict_flag_outcomes(spark, sf_dir):
    p = predictions(spark, sf_dir)
    t = order.higher_quantile(p.where("label = 0"), "score", 0.95).select("threshold")
    out = metrics.flagged(p, "score", t)
    return six(out.select("image_id", outcome(F.col("label") == 1, F.col("flagged")).alias("outcome"), "margin", "ratio"), "margin", "ratio")


@query("A20", f"""WITH {PREDICTIONS}, c AS (SELECT grp, count(*) FILTER (label = 1 AND score > 60) AS tp, count(*) FILTER (label = 1 AND NOT score > 60) AS fn,
count(*) FILTER (label = 0 AND score > 60) AS fp, count(*) FILTER (label = 0 AND NOT score > 60) AS tn FROM pred GROUP BY grp)
SELECT *, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall, round(fp / nullif(fp + tn, 0), 6) AS fpr FROM c""")
def confusion_metrics(spark, sf_dir):
    p = predictions(spark, sf_dir)
    return six(metrics.confusion(p, "label", strictly_above(F.col("score"), F.lit(60.0)), ["grp"]), "precision", "recall", "fpr")


@query("Q5 W12", _CUM + " SELECT CAST(sum(pos) AS BIGINT) AS positives, round(sum(pos * cp / (cp + cn)) / nullif(sum(pos), 0), 6) AS average_precision FROM c")
def average_precision(spark, sf_dir):
    return six(metrics.average_precision(predictions(spark, sf_dir), "label", "score"), "average_precision")


@query("Q6", _CUM + " SELECT CAST(sum(pos) AS BIGINT) AS positives, CAST(sum(neg) AS BIGINT) AS negatives, round(sum(neg * (cp - pos / 2)) / nullif(sum(pos) * sum(neg), 0), 6) AS auroc FROM c")
def auroc_ties(spark, sf_dir):
    return six(metrics.auroc(predictions(spark, sf_dir), "label", "score"), "auroc")


@query("Q7", _CUM + """ SELECT score AS threshold, CAST(cp - pos AS BIGINT) AS true_positives, CAST(cn - neg AS BIGINT) AS false_positives, round((cp - pos) / nullif(p, 0), 6) AS recall,
round((cn - neg) / nullif(n, 0), 6) AS fpr FROM c UNION ALL SELECT NULL, CAST(max(p) AS BIGINT), CAST(max(n) AS BIGINT), 1.0, 1.0 FROM c""")
def strict_roc(spark, sf_dir):
    return six(metrics.strict_roc(predictions(spark, sf_dir), "label", "score"), "recall", "fpr")


@query("Q8 W1 W2", _CUM + """, r AS (SELECT score AS threshold, cp - pos AS tp, cn - neg AS fp, (cp - pos) / p AS recall, (cn - neg) / n AS fpr FROM c UNION ALL SELECT NULL, max(p), max(n), 1.0, 1.0 FROM c),
b AS (SELECT unnest([0.0, 0.01, 0.02, 0.05, 0.1, 0.2, 1.0])::DOUBLE AS budget)
SELECT budget, threshold, round(recall, 6) AS recall, round(fpr, 6) AS fpr, CAST(tp AS BIGINT) AS true_positives, CAST(fp AS BIGINT) AS false_positives FROM r JOIN b ON fpr <= budget
QUALIFY row_number() OVER (PARTITION BY budget ORDER BY recall DESC, fpr, threshold DESC NULLS LAST) = 1""")
def recall_at_fpr(spark, sf_dir):
    return six(metrics.recall_at_fpr(predictions(spark, sf_dir), "label", "score", [0.0, 0.01, 0.02, 0.05, 0.1, 0.2, 1.0]), "recall", "fpr")


@query("W11", f"""WITH {PREDICTIONS}, g AS (SELECT kind, score, count(*) AS n FROM pred GROUP BY kind, score)
SELECT kind, score, n, round(sum(n) OVER (PARTITION BY kind ORDER BY score) / sum(n) OVER (PARTITION BY kind), 6) AS share FROM g""")
def ecdf(spark, sf_dir):
    return six(order.ecdf(predictions(spark, sf_dir), "score", ["kind"]), "share")


@query("A22", f"""WITH {PREDICTIONS}, g AS (SELECT kind, count(*) FILTER (score > 60) AS hits, count(*) AS n FROM pred GROUP BY kind), p AS (SELECT *, hits / n AS p, 1.959963984540054 AS z FROM g)
SELECT kind, hits, n, round((p + z * z / (2 * n) - z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n), 6) AS low,
round((p + z * z / (2 * n) + z * sqrt(p * (1 - p) / n + z * z / (4 * n * n))) / (1 + z * z / n), 6) AS high FROM p""")
def wilson_ci(spark, sf_dir):
    g = predictions(spark, sf_dir).groupBy("kind").agg(F.count_if(F.col("score") > 60).alias("hits"), F.count("*").alias("n"))
    low, high = metrics.wilson(F.col("hits"), F.col("n"))
    return g.select("kind", "hits", "n", rounded(low).alias("low"), rounded(high).alias("high"))


@query("A23", f"""WITH {PREDICTIONS}, g AS (SELECT score, count(*) FILTER (label = 0) AS a, count(*) FILTER (label = 1) AS b FROM pred GROUP BY score),
c AS (SELECT sum(a) OVER w / sum(a) OVER () AS fa, sum(b) OVER w / sum(b) OVER () AS fb, sum(a) OVER () AS n_a, sum(b) OVER () AS n_b FROM g WINDOW w AS (ORDER BY score))
, s AS (SELECT max(abs(fa - fb)) AS statistic, CAST(max(n_a) AS BIGINT) AS n_a, CAST(max(n_b) AS BIGINT) AS n_b FROM c), x AS (SELECT *, sqrt(n_a::DOUBLE * n_b / (n_a + n_b)) AS root FROM s), y AS (SELECT *, (root + 0.12 + 0.11 / root) * statistic AS z FROM x)
SELECT round(statistic, 6) AS statistic, n_a, n_b, round(CASE WHEN z > 0.2 THEN least(1.0, greatest(0.0, list_sum(list_transform(range(1, 101), lambda j: (CASE WHEN j % 2 = 1 THEN 2.0 ELSE -2.0 END)::DOUBLE * exp(-2 * power(j * z, 2)))))) ELSE 1.0 END, 6) AS p_value FROM y""")
def kolmogorov_smirnov(spark, sf_dir):
    out = metrics.kolmogorov_smirnov(predictions(spark, sf_dir), "score", F.col("label") == 1)
    return six(out.withColumn("p_value", metrics.kolmogorov_p(F.col("statistic"), F.col("n_a"), F.col("n_b"))), "statistic", "p_value")


@query("A24", f"""WITH {PREDICTIONS}, r AS (SELECT rank() OVER (ORDER BY size) + (count(*) OVER (PARTITION BY size) - 1) / 2 AS a, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS b FROM pred)
SELECT count(*) AS n, round(corr(a, b), 6) AS rho FROM r""")
def spearman(spark, sf_dir):
    return six(metrics.spearman(predictions(spark, sf_dir), "size", "score"), "rho")


@query("Q15 A13", f"""WITH {PREDICTIONS}, a AS (SELECT kind, avg(score) AS v FROM pred GROUP BY kind), b AS (SELECT kind, sum(score) / count(*) AS v FROM pred GROUP BY kind UNION ALL SELECT 'absent', NULL)
SELECT coalesce(a.kind, b.kind) AS kind, (a.v IS NULL AND b.v IS NULL) OR coalesce(abs(a.v - b.v) <= 1e-12 + 1e-10 * abs(b.v), false) AS same, a.kind IS NOT NULL AND b.kind IS NOT NULL AS in_both
FROM a FULL JOIN b ON a.kind = b.kind""")
def metric_comparison(spark, sf_dir):
    p = predictions(spark, sf_dir)
    a = p.groupBy("kind").agg(F.avg("score").alias("a")).withColumn("in_a", F.lit(True))
    b = p.groupBy("kind").agg((F.sum("score") / F.count("*")).alias("b")).unionByName(spark.createDataFrame([("absent", None)], "kind string, b double")).withColumn("in_b", F.lit(True))
    met = a.join(b, "kind", "full")
    same = (F.col("a").isNull() & F.col("b").isNull()) | F.coalesce(F.abs(F.col("a") - F.col("b")) <= 1e-12 + 1e-10 * F.abs("b"), F.lit(False))
    return met.select("kind", same.alias("same"), (F.col("in_a").isNotNull() & F.col("in_b").isNotNull()).alias("in_both"))


@query("Q16", f"""WITH {PREDICTIONS}, m AS (SELECT grp, avg(CASE WHEN score > 60 THEN 1.0 ELSE 0.0 END) FILTER (label = 1) AS recall, avg(CASE WHEN score > 60 THEN 1.0 ELSE 0.0 END) FILTER (label = 0) AS fpr,
quantile_cont(size, 0.5) AS latency, count(*) AS n FROM pred GROUP BY grp)
SELECT grp, recall >= 0.28 AS recall_ok, fpr <= 0.31 AS fpr_ok, latency <= 50 AS latency_ok, n >= 100 AS count_ok, recall >= 0.28 AND fpr <= 0.31 AND latency <= 50 AND n >= 100 AS accepted FROM m""")
def acceptance_gate(spark, sf_dir):
    hit = (F.col("score") > 60).cast("double")
    p = predictions(spark, sf_dir)
    m = p.groupBy("grp").agg(F.avg(F.when(F.col("label") == 1, hit)).alias("recall"), F.avg(F.when(F.col("label") == 0, hit)).alias("fpr"), F.count("*").alias("n"))
    m = order.with_quantiles(m, p.withColumn("size", F.col("size").cast("double")), {"size": {"latency": 0.5}}, ["grp"])
    ok = {"recall_ok": F.col("recall") >= 0.28, "fpr_ok": F.col("fpr") <= 0.31, "latency_ok": F.col("latency") <= 50, "count_ok": F.col("n") >= 100}
    return m.select("grp", *[c.alias(k) for k, c in ok.items()], (ok["recall_ok"] & ok["fpr_ok"] & ok["latency_ok"] & ok["count_ok"]).alias("accepted"))


_RANKED = f"""WITH {PREDICTIONS}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, image_id) AS rank FROM pred)"""


@query("Q10", _RANKED + """ SELECT user_id, min(rank) FILTER (label = 1) AS first_rank, round(avg(score) FILTER (rank <= 1), 6) AS top1, round(avg(score) FILTER (rank <= 3), 6) AS top3,
round(avg(score) FILTER (rank <= 10), 6) AS top10, round(avg(CAST(label AS DOUBLE)) FILTER (rank <= 5), 6) AS truth5, round(quantile_cont(score, 0.9), 6) AS p90, round(quantile_cont(score, 0.99), 6) AS p99,
round(avg(score) FILTER (rank <= ceil(0.01 * n)), 6) AS top_percent FROM (SELECT *, count(*) OVER (PARTITION BY user_id) AS n FROM r) GROUP BY user_id""")
def rank_diagnostics(spark, sf_dir):
    own = Window.partitionBy("user_id")
    r = predictions(spark, sf_dir).withColumns({"rank": F.row_number().over(own.orderBy(F.desc("score"), "image_id")).cast("long"), "n": F.count("*").over(own)})
    top = lambda k, c="score": F.avg(F.when(F.col("rank") <= k, F.col(c)))
    out = r.groupBy("user_id").agg(
        F.min(F.when(F.col("label") == 1, F.col("rank"))).alias("first_rank"), top(1).alias("top1"), top(3).alias("top3"), top(10).alias("top10"), top(5, "label").alias("truth5"),
        F.avg(F.when(F.col("rank") <= F.ceil(0.01 * F.col("n")), F.col("score"))).alias("top_percent"),
    )
    out = order.with_quantiles(out, r, {"score": {"p90": 0.9, "p99": 0.99}}, ["user_id"])
    return six(out, "top1", "top3", "top10", "truth5", "p90", "p99", "top_percent")


@query("Q11", f"""WITH {PREDICTIONS}, f AS (SELECT image_id, concat_ws('|', CASE WHEN score < 10 THEN 'F1' END, CASE WHEN size > 80 THEN 'F2' END, CASE WHEN grp = 0 THEN 'F3' END, CASE WHEN score > 150 THEN 'F4' END) AS flags FROM pred)
SELECT image_id, CASE WHEN flags = '' THEN 'F5' ELSE flags END AS flags FROM f""")
def failure_flags(spark, sf_dir):
    c = F.col
    return predictions(spark, sf_dir).select("image_id", piped((c("score") < 10, "F1"), (c("size") > 80, "F2"), (c("grp") == 0, "F3"), (c("score") > 150, "F4"), otherwise="F5").alias("flags"))


@query("A24")
def spearman_test(spark, sf_dir):
    """The rank correlation with its p-value; SQL has no Student distribution."""
    r = metrics.spearman(predictions(spark, sf_dir), "size", "score").first()
    return spark.createDataFrame([(r["n"], r["rho"], metrics.spearman_p(r["rho"], r["n"]))], "n long, rho double, p_value double")


@query("K8", f"""WITH {PREDICTIONS} SELECT image_id, round(least(2.0, greatest(0.0, score / 60)), 6) AS ratio, CAST(least(4, floor(least(2.0, greatest(0.0, score / 60)) / 2 * 5)) AS INTEGER) AS shade FROM pred""")
def ratio_scale(spark, sf_dir):
    """A score as a share of the threshold on a fixed scale of 0 to 2, and its shade of five; what a picture of it shows."""
    ratio = F.least(F.lit(2.0), F.greatest(F.lit(0.0), safe_ratio(F.col("score"), F.lit(60.0))))
    return predictions(spark, sf_dir).select("image_id", rounded(ratio).alias("ratio"), F.least(F.lit(4), F.floor(ratio / 2 * 5)).cast("int").alias("shade"))


@query("Q12", f"""WITH {PREDICTIONS}, u AS (SELECT user_id, max(score) FILTER (label = 1) AS inside, max(score) FILTER (label = 0) AS outside, count(*) FILTER (size > 60) > 0 AS detected FROM pred GROUP BY user_id),
c AS (SELECT user_id, concat_ws('|', CASE WHEN inside <= 60 THEN 'low_response' END, CASE WHEN outside > inside THEN 'higher_outside' END, CASE WHEN NOT detected AND inside > 60 THEN 'evidence_unflagged' END) AS categories FROM u WHERE inside IS NOT NULL)
SELECT user_id, CASE WHEN categories = '' THEN 'unclear_or_mixed' ELSE categories END AS categories FROM c""")
def case_categories(spark, sf_dir):
    """What the evidence says of each case: a weak response, a stronger one elsewhere, evidence without a flag, or neither."""
    best = lambda v: F.max(F.when(F.col("label") == v, F.col("score")))
    u = predictions(spark, sf_dir).groupBy("user_id").agg(best(1).alias("inside"), best(0).alias("outside"), (F.count_if(F.col("size") > 60) > 0).alias("detected")).where("inside IS NOT NULL")
    c = F.col
    return u.select("user_id", piped((c("inside") <= 60, "low_response"), (c("outside") > c("inside"), "higher_outside"), (~c("detected") & (c("inside") > 60), "evidence_unflagged"), otherwise="unclear_or_mixed").alias("categories"))


@query("A17 W15", f"""WITH {PREDICTIONS} SELECT kind, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share, round(sum(score) / sum(sum(score)) OVER (), 6) AS score_share FROM pred GROUP BY kind""")
def composition(spark, sf_dir):
    g = predictions(spark, sf_dir).groupBy("kind").agg(F.count("*").alias("n"), F.sum("score").alias("s"))
    every = Window.partitionBy()
    return g.select("kind", "n", rounded(F.col("n") / F.sum("n").over(every)).alias("share"), rounded(F.col("s") / F.sum("s").over(every)).alias("score_share"))


@query("A1 A26", "SELECT lang, source, count(*) AS n FROM documents GROUP BY lang, source")
def value_counts(spark, sf_dir):
    from ..sources.files import read_table

    return read_table(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"))


@query("A21 A30", f"""WITH {PREDICTIONS}, m AS (SELECT grp, label, quantile_cont(score, 0.5) AS med, sum(size) AS burden FROM pred GROUP BY grp, label)
SELECT grp, round(max(CASE WHEN label = 1 THEN med END) / nullif(max(CASE WHEN label = 0 THEN med END), 0), 6) AS median_ratio,
round(max(CASE WHEN label = 1 THEN burden END) / nullif(sum(burden), 0), 6) AS burden_share FROM m GROUP BY grp""")
def burden_contrast(spark, sf_dir):
    p = predictions(spark, sf_dir)
    m = order.with_quantiles(p.groupBy("grp", "label").agg(F.sum("size").alias("burden")), p, {"score": {"med": 0.5}}, ["grp", "label"])
    of = lambda c, v: F.max(F.when(F.col("label") == v, F.col(c)))
    out = m.groupBy("grp").agg(safe_ratio(of("med", 1), of("med", 0)).alias("median_ratio"), safe_ratio(of("burden", 1), F.sum("burden")).alias("burden_share"))
    return six(out, "median_ratio", "burden_share")


