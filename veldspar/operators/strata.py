"""Strata: quartiles and bands, group summaries that keep empty groups, several labels per row, paired recipes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import safe_ratio
from .order import higher_quantiles, with_quantiles


def quartile_edges(df: DataFrame, value: str) -> DataFrame:
    """One row e1, e2, e3: the quartiles' upper edges, as sorted values at places rounded up."""
    return higher_quantiles(df, value, {"e1": 0.25, "e2": 0.5, "e3": 0.75}).agg(*[F.max(e).alias(e) for e in ("e1", "e2", "e3")])


def band(value: Column, edges: list[Column], names: list[str]) -> Column:
    """The first band whose upper edge isn't passed; equal values stay together."""
    out = F.when(value.isNull(), F.lit(None).cast("string"))
    for edge, name in zip(edges, names):
        out = out.when(value <= edge, name)
    return out.otherwise(names[len(edges)])


def size_quartiles(df: DataFrame, value: str, name: str = "size_quartile") -> DataFrame:
    met = df.crossJoin(F.broadcast(quartile_edges(df, value)))
    return met.withColumn(name, band(F.col(value), [F.col("e1"), F.col("e2"), F.col("e3")], ["Q1", "Q2", "Q3", "Q4"])).drop("e1", "e2", "e3")


def keep_groups(dimension: DataFrame, aggregated: DataFrame, keys: list[str], counts: list[str]) -> DataFrame:
    """All groups of ``dimension``; the counts of absent ones are 0 and all else of theirs is null."""
    return dimension.join(aggregated, keys, "left").fillna(0, counts)


def summary(df: DataFrame, by: list[str], flag: str, size: str, score: str, margin: str) -> DataFrame:
    """Counts, recall, range of sizes and medians of each group."""
    f = F.col(flag)
    counts = df.groupBy(*by).agg(
        F.count("*").alias("n"), F.count_if(f).alias("detected"), F.count_if(~f).alias("missed"), safe_ratio(F.count_if(f), F.count("*")).alias("recall"), F.min(size).alias("min_size"), F.max(size).alias("max_size")
    )
    return with_quantiles(counts, df, {size: {"median_size": 0.5}, score: {"median_score": 0.5}, margin: {"median_margin": 0.5}}, by)


def spread(df: DataFrame, by: list[str], columns: dict[str, str]) -> DataFrame:
    """Of each group and column, under its prefix: count, median, quartiles by linear quantiles, and range."""
    sums = df.groupBy(*by).agg(*[f(x).alias(p + n) for x, p in columns.items() for f, n in ((F.count, "count"), (F.min, "min"), (F.max, "max"))])
    return with_quantiles(sums, df, {x: {f"{p}median": 0.5, f"{p}p25": 0.25, f"{p}p75": 0.75} for x, p in columns.items()}, by)


def members(*groups: tuple[Column, str]) -> Column:
    """The names of all groups that a row is in; a row may be in several."""
    return F.array_compact(F.array(*[F.when(c, F.lit(name)) for c, name in groups]))


def per_label(df: DataFrame, labels: str, name: str = "label") -> DataFrame:
    """One row per row and label of an array of labels."""
    return df.withColumn(name, F.explode(labels)).drop(*([labels] if labels != name else []))


def paired(df: DataFrame, key: str, recipe: str, values: list[str], columns: list[str]) -> DataFrame:
    """The two recipes of each key side by side: columns value_recipe."""
    picks = [F.max(F.when(F.col(recipe) == v, F.col(c))).alias(f"{c}_{v}") for c in columns for v in values]
    return df.groupBy(key).agg(*picks)


def unpivoted(df: DataFrame, keys: list[str], columns: list[str], name: str = "metric", value: str = "value") -> DataFrame:
    return df.unpivot([F.col(k) for k in keys], [F.col(c).cast("double").alias(c) for c in columns], name, value)


def outcome_pair(first: Column, second: Column) -> Column:
    """M1 both miss, M2 the second rescues, M3 both hit, M4 the first only."""
    return F.when(~first & ~second, "M1").when(~first & second, "M2").when(first & second, "M3").otherwise("M4")
