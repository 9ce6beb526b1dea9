"""Deterministic selection: best rows, rows near a statistic, systematic samples, rules in order of priority."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .order import linear_quantiles, running, value_counts


def first_rows(df: DataFrame, by: list[str], order: list[Column], n: int = 1, rank: str = "rank") -> DataFrame:
    """The first n rows of each group. Spark cuts groups to n rows before it sends them on."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col(rank) <= n)


def top_rows(df: DataFrame, order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """The first n rows overall; only they reach the one task that ranks them."""
    return df.orderBy(*order).limit(n).withColumn(rank, F.row_number().over(Window.orderBy(*order)))


def best(df: DataFrame, by: list[str], key: list[Column], columns: list[str]) -> DataFrame:
    """The row with the least key of each group, by aggregation, so that a hot group is combined before the shuffle."""
    picked = F.min(F.struct(*[k.alias(f"_k{i}") for i, k in enumerate(key)], *columns)).alias("_m")
    return df.groupBy(*by).agg(picked).select(*by, *[F.col(f"_m.{c}").alias(c) for c in columns])


def nearest_to_median(df: DataFrame, by: list[str], value: str, id_col: str) -> DataFrame:
    """The row of each group that is closest to its median; ties to the smaller id."""
    met = df.join(linear_quantiles(df, value, {"median": 0.5}, by), by)
    return best(met, by, [F.abs(F.col(value) - F.col("median")), F.col(id_col)], [id_col, value, "median"])


def at_places(df: DataFrame, order: list[str], places: DataFrame) -> DataFrame:
    """Rows at 0-based places of the total order of ``order`` (numbers), found by running counts, not by one sorted task."""
    counts = df.groupBy(order[0]).agg(F.count("*").alias("n"))
    cum = running(counts, order[0], ["n"]).select(F.col(order[0]).alias("_v"), (F.col("cum_n") - F.col("n")).alias("_before"))
    own = Window.partitionBy(order[0]).orderBy(*order[1:])
    numbered = df.join(cum, F.col(order[0]) == F.col("_v")).withColumn("place", F.col("_before") + F.row_number().over(own) - 1).drop("_v", "_before")
    return numbered.join(places, "place")


def middle_rows(df: DataFrame, by: list[str], value: str, id_col: str) -> DataFrame:
    """The row at place n // 2 of each group by value, then id: the value comes from running counts, and only the rows that
    have it are numbered."""
    counts = value_counts(df, value, by)
    cum = running(counts, value, ["n"], by).select(*[F.col(k).alias(f"_by_{k}") for k in by], F.col(value).alias("_v"), "n", "cum_n")
    totals = counts.groupBy(*[F.col(k).alias(f"_of_{k}") for k in by]).agg(F.sum("n").alias("_total"))
    hit = cum.join(totals, [F.col(f"_by_{k}").eqNullSafe(F.col(f"_of_{k}")) for k in by]).where("_total div 2 >= cum_n - n AND _total div 2 < cum_n")
    hit = hit.withColumn("_place", F.expr("_total div 2 - (cum_n - n)")).select(*[f"_by_{k}" for k in by], "_v", "_place")
    met = df.join(hit, [F.col(k).eqNullSafe(F.col(f"_by_{k}")) for k in by] + [F.col(value) == F.col("_v")])
    numbered = met.withColumn("_i", F.row_number().over(Window.partitionBy(*[f"_by_{k}" for k in by]).orderBy(id_col)) - 1)
    return numbered.where(F.col("_i") == F.col("_place")).select(*df.columns)


def with_reasons(tagged: DataFrame, id_col: str, reason: str) -> DataFrame:
    """(id, reasons): all reasons of each id, in order of their names."""
    return tagged.groupBy(id_col).agg(F.array_join(F.array_sort(F.collect_set(reason)), "|").alias("reasons"))


def by_priority(tagged: DataFrame, id_col: str, rule: str, most: int) -> DataFrame:
    """Of rows (id, rule number) the first ``most`` ids by their first rule, then id, with all further rules."""
    rows = tagged.groupBy(id_col).agg(F.min(rule).alias("first_rule"), F.array_sort(F.collect_set(rule)).alias("rules"))
    chosen = top_rows(rows, [F.col("first_rule"), F.col(id_col)], most, "place")
    return chosen.select(id_col, "place", "first_rule", F.array_join(F.expr("filter(rules, r -> r <> first_rule)"), "|").alias("additional_rules"))


def hashed_sample(df: DataFrame, id_col: str, n: int, seed: str = "42") -> DataFrame:
    """n rows without replacement, by SHA-256 of seed and id."""
    key = F.sha2(F.concat_ws("|", F.lit(seed), F.col(id_col).cast("string")), 256)
    return df.withColumn("sample_key", key).orderBy("sample_key").limit(n)
