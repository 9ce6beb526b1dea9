import numpy as np
import pytest
from pyspark.sql import functions as F

from veldspar.functions.scalar import half_even, labels_of, outcome, piped, safe_ratio, strictly_above
from veldspar.operators import metrics, order, strata


def ranking(spark, labels, scores):
    return spark.createDataFrame([(int(a), float(b)) for a, b in zip(labels, scores)], "label int, score double")


def plain_ap(y, s):
    out, tp, n = 0.0, 0, 0
    for v in sorted(set(s), reverse=True):
        pos = sum(a for a, b in zip(y, s) if b == v)
        tp, n = tp + pos, n + sum(b == v for b in s)
        out += pos * tp / n
    return out / sum(y)


def plain_auroc(y, s):
    pairs = [(a, b) for a, p in zip(s, y) if p for b, q in zip(s, y) if not q]
    return sum(1.0 if a > b else 0.5 if a == b else 0.0 for a, b in pairs) / len(pairs)


def test_higher_quantile_takes_the_sorted_value_rounded_up(spark):
    df = spark.createDataFrame([(float(i),) for i in range(20)], "v double")
    assert order.higher_quantile(df, "v", 0.95).first()["threshold"] == 19
    one = spark.createDataFrame([(3.0,)], "v double")
    assert order.higher_quantile(one, "v", 0.95).first()["threshold"] == 3
    assert order.higher_quantile(df.limit(0), "v", 0.95).count() == 0


def test_higher_quantile_ignores_nan_and_null_and_agrees_with_numpy(spark):
    rng = np.random.default_rng(1)
    rows = [(float(v), g) for g in ("a", None) for v in np.round(rng.normal(size=301), 1)]
    df = spark.createDataFrame(rows + [(float("nan"), "a"), (None, "a")], "v double, g string")
    got = {r["g"]: r["threshold"] for r in order.higher_quantile(df, "v", 0.9, ["g"]).collect()}
    for g in ("a", None):
        assert got[g] == np.quantile([v for v, h in rows if h == g], 0.9, method="higher")


def test_equality_is_never_flagged(spark):
    df = spark.createDataFrame([(18.0,), (19.0,), (20.0,), (float("nan"),), (None,)], "s double")
    assert [r[0] for r in df.select(strictly_above(F.col("s"), F.lit(19.0))).collect()] == [False, False, True, False, False]


def test_confusion_and_ranking_of_four(spark):
    df = ranking(spark, [0, 0, 1, 1], [0, 4, 2, 5])
    row = metrics.confusion(df, "label", strictly_above(F.col("score"), F.lit(3.0))).first()
    assert (row["tp"], row["fp"], row["fn"], row["tn"]) == (1, 1, 1, 1)
    assert row["precision"] == row["recall"] == row["fpr"] == 0.5
    assert metrics.auroc(df, "label", "score").first()["auroc"] == 0.75
    assert abs(metrics.average_precision(df, "label", "score").first()["average_precision"] - 5 / 6) < 1e-12


def test_one_class_is_undefined(spark):
    df = ranking(spark, [0, 0], [0, 1])
    assert metrics.auroc(df, "label", "score").first()["auroc"] is None
    assert metrics.average_precision(df, "label", "score").first()["average_precision"] is None
    assert metrics.confusion(df, "label", F.lit(False)).first()["precision"] is None


@pytest.mark.parametrize("seed", [0, 1])
def test_ranking_metrics_agree_with_direct_sums_on_ties(spark, seed):
    rng = np.random.default_rng(seed)
    y, s = rng.integers(0, 2, 200), rng.integers(0, 12, 200).astype(float)
    df = ranking(spark, y, s)
    assert abs(metrics.average_precision(df, "label", "score").first()["average_precision"] - plain_ap(list(y), list(s))) < 1e-9
    assert abs(metrics.auroc(df, "label", "score").first()["auroc"] - plain_auroc(list(y), list(s))) < 1e-9


def test_roc_never_splits_ties_and_keeps_to_the_budget(spark):
    y, s = [1, 0, 1, 0], [0.9, 0.9, 0.8, 0.1]
    roc = metrics.strict_roc(ranking(spark, y, s), "label", "score").orderBy(F.desc_nulls_last("threshold")).collect()
    assert (roc[0]["true_positives"], roc[0]["false_positives"]) == (0, 0)
    assert (roc[-1]["true_positives"], roc[-1]["false_positives"], roc[-1]["threshold"]) == (2, 2, None)
    got = {r["budget"]: (r["recall"], r["fpr"]) for r in metrics.recall_at_fpr(ranking(spark, y, s), "label", "score", [0.0, 0.5, 1.0]).collect()}
    assert got == {0.0: (0.0, 0.0), 0.5: (1.0, 0.5), 1.0: (1.0, 0.5)}


def test_quartiles_keep_ties_together(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([0.1] * 4 + [0.2, 0.2, 0.3, 0.4])], "id int, v double")
    got = {r["v"]: set() for r in df.collect()}
    for r in strata.size_quartiles(df, "v").collect():
        got[r["v"]].add(r["size_quartile"])
    assert all(len(q) == 1 for q in got.values()) and got[0.1] == {"Q1"}
    same = spark.createDataFrame([(0.1,)] * 4, "v double")
    assert {r["size_quartile"] for r in strata.size_quartiles(same, "v").collect()} == {"Q1"}


def test_small_statistics(spark):
    df = spark.createDataFrame([(1.0, 10.0, False), (2.0, 20.0, True), (2.0, 15.0, False), (9.0, 40.0, True)], "a double, b double, second boolean")
    assert abs(metrics.spearman(df, "a", "b").first()["rho"] - 0.9486832980505138) < 1e-9
    assert metrics.kolmogorov_smirnov(df, "a", F.col("second")).first()["statistic"] == 0.5
    p = lambda d, n: metrics.kolmogorov_p(F.lit(d), F.lit(n), F.lit(n))
    row = spark.range(1).select(p(0.0, 10).alias("none"), p(1.0, 50).alias("all"), p(0.136, 200).alias("some")).first()
    assert row["none"] == 1.0 and row["all"] < 1e-9 and 0.04 < row["some"] < 0.06  # 1.36 / sqrt(n / 2) is the 5% point


def test_scalar_functions(spark):
    row = spark.range(1).select(
        safe_ratio(F.lit(1), F.lit(0)).alias("none"), half_even(F.lit(2.5)).alias("even"), labels_of(F.lit("melt, scratch,missing")).alias("three"), labels_of(F.lit("melt,melt")).alias("twice"),
        piped((F.lit(True), "F1"), (F.lit(True), "F3"), otherwise="F5").alias("flags"), piped((F.lit(False), "F1"), otherwise="F5").alias("rest"), outcome(F.lit(True), F.lit(False)).alias("o"),
    ).first()
    assert (row["none"], row["even"], row["three"], row["twice"], row["flags"], row["rest"], row["o"]) == (None, 2.0, ["melt", "scratch", "missing"], None, "F1|F3", "F5", "FN")
