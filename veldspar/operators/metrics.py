"""Ranking metrics, confusion and small statistics. Undefined values are null.

A ranking is a DataFrame with a label of 0 or 1 and a score; equal scores count as one step.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import safe_ratio, strictly_above
from .order import running, value_counts


def grouped(df: DataFrame, label: str, score: str) -> DataFrame:
    """(score, pos, neg) with their running sums from the highest score down."""
    by_score = df.groupBy(F.col(score).alias("score")).agg(F.sum(F.col(label).cast("long")).alias("pos"), F.sum((1 - F.col(label)).cast("long")).alias("neg"))
    return running(by_score, "score", ["pos", "neg"], descending=True)


def average_precision(df: DataFrame, label: str, score: str) -> DataFrame:
    g = grouped(df, label, score)
    terms = g.agg(F.sum(F.col("pos") * F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))).alias("hits"), F.sum("pos").alias("positives"))
    return terms.select("positives", safe_ratio(F.col("hits"), F.col("positives")).alias("average_precision"))


def auroc(df: DataFrame, label: str, score: str) -> DataFrame:
    """The share of pairs that are in order, half for ties."""
    g = grouped(df, label, score)
    won = g.agg(F.sum(F.col("neg") * (F.col("cum_pos") - F.col("pos") / 2)).alias("won"), F.sum("pos").alias("positives"), F.sum("neg").alias("negatives"))
    return won.select("positives", "negatives", safe_ratio(F.col("won"), F.col("positives") * F.col("negatives")).alias("auroc"))


def strict_roc(df: DataFrame, label: str, score: str) -> DataFrame:
    """(threshold, true_positives, false_positives, recall, fpr) for flags strictly above each distinct score, and one
    row with a null threshold that flags everything."""
    g = grouped(df, label, score)
    totals = g.agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    rows = g.select(F.col("score").alias("threshold"), (F.col("cum_pos") - F.col("pos")).alias("true_positives"), (F.col("cum_neg") - F.col("neg")).alias("false_positives"))
    last = totals.select(F.lit(None).cast("double").alias("threshold"), F.col("p").alias("true_positives"), F.col("n").alias("false_positives"))
    return rows.unionByName(last).crossJoin(F.broadcast(totals)).select(
        "threshold", "true_positives", "false_positives", safe_ratio(F.col("true_positives"), F.col("p")).alias("recall"), safe_ratio(F.col("false_positives"), F.col("n")).alias("fpr")
    )


def recall_at_fpr(df: DataFrame, label: str, score: str, budgets: list[float]) -> DataFrame:
    """For each budget the operating point of highest recall, then lowest rate, then highest threshold."""
    spark = df.sparkSession
    roc = strict_roc(df, label, score)
    asked = spark.createDataFrame([(float(b),) for b in budgets], "budget double")
    met = roc.join(F.broadcast(asked), F.col("fpr") <= F.col("budget"))
    point = F.struct((-F.col("recall")).alias("a"), F.col("fpr").alias("b"), F.coalesce(-F.col("threshold"), F.lit(float("inf"))).alias("c"), "threshold", "recall", "fpr", "true_positives", "false_positives")
    return met.groupBy("budget").agg(F.min(point).alias("p")).select("budget", "p.threshold", "p.recall", "p.fpr", "p.true_positives", "p.false_positives")


def confusion(df: DataFrame, label: str, flagged: Column, by: list[str] | None = None) -> DataFrame:
    positive = F.col(label) == 1
    out = df.groupBy(*(by or [])).agg(
        F.count_if(positive & flagged).alias("tp"), F.count_if(positive & ~flagged).alias("fn"), F.count_if(~positive & flagged).alias("fp"), F.count_if(~positive & ~flagged).alias("tn")
    )
    return out.select("*", safe_ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), safe_ratio(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"), safe_ratio(F.col("fp"), F.col("fp") + F.col("tn")).alias("fpr"))


def wilson(hits: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """The 95% interval of a share."""
    p, n = safe_ratio(hits, n), n.cast("double")
    middle, spread = p + z * z / (2 * n), z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n))
    scale = 1 + z * z / n
    return (middle - spread) / scale, (middle + spread) / scale


def kolmogorov_smirnov(df: DataFrame, value: str, second: Column) -> DataFrame:
    """The greatest gap between the distributions of two samples; ``second`` tells the rows of the second one."""
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(F.count_if(~second).alias("a"), F.count_if(second).alias("b"))
    cum = running(counts, "v", ["a", "b"])
    totals = counts.agg(F.sum("a").alias("n_a"), F.sum("b").alias("n_b"))
    gap = F.abs(safe_ratio(F.col("cum_a"), F.col("n_a")) - safe_ratio(F.col("cum_b"), F.col("n_b")))
    return cum.crossJoin(F.broadcast(totals)).agg(F.max(gap).alias("statistic"), F.max("n_a").alias("n_a"), F.max("n_b").alias("n_b"))


def kolmogorov_p(statistic: Column, n_a: Column, n_b: Column, terms: int = 100) -> Column:
    """The asymptotic p-value of the two-sample statistic."""
    root = F.sqrt(n_a.cast("double") * n_b / (n_a + n_b))
    x = (root + 0.12 + 0.11 / root) * statistic
    one = lambda j: F.when(j % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2 * F.pow(j * x, F.lit(2)))
    total = F.aggregate(F.transform(F.sequence(F.lit(1), F.lit(terms)), one), F.lit(0.0), lambda s, t: s + t)
    return F.when(x > 0.2, F.least(F.lit(1.0), F.greatest(F.lit(0.0), total))).otherwise(1.0)


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    from .order import average_ranks

    ranked = average_ranks(average_ranks(df.where(F.col(a).isNotNull() & F.col(b).isNotNull()), a, "_ra"), b, "_rb")
    return ranked.agg(F.count("*").alias("n"), F.corr("_ra", "_rb").alias("rho"))


def student_p(t: float, degrees: float) -> float:
    """The two-sided p-value of Student's t, by the continued fraction of the incomplete beta function."""
    if math.isinf(t):
        return 0.0
    x, a, b = degrees / (degrees + t * t), degrees / 2, 0.5
    swap = x > (a + 1) / (a + b + 2)
    if swap:
        x, a, b = 1 - x, b, a
    if x == 0:
        return 1.0 if swap else 0.0
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny = 1e-300
    f, c, d = 1.0, 1.0, 0.0
    for i in range(400):
        m = i // 2
        step = 1.0 if i == 0 else m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)) if i % 2 == 0 else -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / (1 + step * d or tiny)
        c = 1 + step / c or tiny
        f *= c * d
        if abs(1 - c * d) < 1e-14:
            break
    p = front * (f - 1)
    return 1 - p if swap else p


def spearman_p(rho: float | None, n: int) -> float | None:
    """The two-sided p-value of a rank correlation of n rows; none for fewer than three."""
    if rho is None or n < 3 or rho != rho:
        return None
    return student_p(math.inf if abs(rho) >= 1 else rho * math.sqrt((n - 2) / (1 - rho * rho)), n - 2)


def flagged(df: DataFrame, score: str, thresholds: DataFrame, by: list[str] | None = None) -> DataFrame:
    """``df`` with threshold, flagged, margin and ratio; thresholds are one row, or one per group."""
    met = df.join(thresholds, by) if by else df.crossJoin(F.broadcast(thresholds))  # one row
    return met.withColumns({
        "flagged": strictly_above(F.col(score), F.col("threshold")), "margin": F.col(score) - F.col("threshold"), "ratio": safe_ratio(F.col(score), F.col("threshold")),
    })


def distinct_values(df: DataFrame, value: str) -> DataFrame:
    return value_counts(df, value).orderBy(value)
