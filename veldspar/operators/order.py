"""Exact order statistics without sorting everything, or one large group, in one task.

Rows are first summed by value, which Spark combines before the shuffle. A histogram of the leading bits of the values (their
sign, exponent and twelve bits of the fraction, which are in the order of the values) deals them into ranges of about
``ROWS`` values, as many as there are values for. Windows run within a range, and sums over whole ranges, one row each,
carry over from range to range. Equal values never part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: About how many values a range holds, and steps of the histogram in an octave.
ROWS, STEPS = 100_000, 4096


def _on(left: DataFrame, right: DataFrame, by: list[str], more: list[str] = ()) -> DataFrame:
    """A join on groups, null ones too, with the left side's group columns."""
    renamed = right.withColumnsRenamed({k: f"_by_{k}" for k in [*by, *more]})
    keys = [left[k].eqNullSafe(renamed[f"_by_{k}"]) for k in [*by, *more]]
    met = left.join(renamed, keys) if keys else left.crossJoin(F.broadcast(renamed))  # one row
    return met.drop(*[f"_by_{k}" for k in [*by, *more]])


def bin_of(value: Column) -> Column:
    """A whole number that is no less for a greater number: sign, exponent and the leading bits of the fraction. Where a
    rounded logarithm misses the exponent by one, the fraction makes up for it."""
    size = F.abs(value.cast("double"))
    exponent = F.floor(F.log2(size))
    fraction = F.floor((size / F.pow(F.lit(2.0), exponent) - 1) * STEPS)
    above = F.when(size == 0, 0).when(size == float("inf"), 4000 * STEPS).otherwise((exponent + 1100) * STEPS + fraction)
    return F.when(value.cast("double") < 0, -above).otherwise(above).cast("long")


def ranged(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """``df`` with _range: ranges of its group's values in order, of about ROWS rows each, or of one bin that has more."""
    dated = df.schema[value].dataType.typeName() == "date"
    binned = df.withColumn("_bin", bin_of(F.unix_date(value) if dated else F.col(value)))
    bins = binned.groupBy(*by, "_bin").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*by).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1))  # STEPS rows an octave
    cuts = bins.select(*by, "_bin", F.floor(F.coalesce(before, F.lit(0)) / ROWS).alias("_range"))
    return _on(binned, cuts, by, ["_bin"]).drop("_bin")


def running(df: DataFrame, value: str, sums: list[str], by: list[str] | None = None, descending: bool = False) -> DataFrame:
    """Sums of the columns ``sums`` over all rows up to and with each value, within the groups ``by``: columns cum_*.

    ``df`` has one row per group and value.
    """
    by = by or []
    dealt = ranged(df, value, by)
    order = F.desc(value) if descending else F.asc(value)
    before = F.desc("_range") if descending else F.asc("_range")
    totals = dealt.groupBy(*by, "_range").agg(*[F.sum(c).alias(f"_t_{c}") for c in sums])
    earlier = Window.partitionBy(*by).orderBy(before).rowsBetween(Window.unboundedPreceding, -1)  # a row for each ROWS values
    offsets = totals.select(*by, "_range", *[F.coalesce(F.sum(f"_t_{c}").over(earlier), F.lit(0)).alias(f"_o_{c}") for c in sums])
    inside = Window.partitionBy(*by, "_range").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = dealt.select("*", *[F.sum(c).over(inside).alias(f"_l_{c}") for c in sums])
    met = _on(local, offsets, [*by, "_range"])
    return met.select(*df.columns, *[(F.col(f"_l_{c}") + F.col(f"_o_{c}")).alias(f"cum_{c}") for c in sums])


def value_counts(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """(by..., value, n) of values that are finite numbers."""
    x = F.col(value)
    return df.where(x.isNotNull() & ~F.isnan(x)).groupBy(*(by or []), value).agg(F.count("*").alias("n"))


def _with_totals(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """(by..., value, n, cum_n, total): each value's count, the running one and its group's."""
    counts = value_counts(df, value, by)
    met = _on(running(counts, value, ["n"], by), counts.groupBy(*by).agg(F.sum("n").alias("total")), by)
    return met.select(*by, F.col(value).alias("_v"), "n", "cum_n", "total")


def _at(place: Column) -> Column:
    """The value at a place of the group's order, counted from 0."""
    return F.max(F.when((F.col("cum_n") - F.col("n") <= place) & (place < F.col("cum_n")), F.col("_v")))


def higher_quantiles(df: DataFrame, value: str, named: dict[str, float], by: list[str] | None = None) -> DataFrame:
    """(by..., n, and a column for each named q): the sorted value at place ceil(q * (n - 1)), counted from 0."""
    found = [_at(F.ceil(F.lit(q) * (F.col("total") - 1))).alias(name) for name, q in named.items()]
    return _with_totals(df, value, by or []).groupBy(*(by or [])).agg(F.max("total").alias("n"), *found).where(F.col("n").isNotNull())


def higher_quantile(df: DataFrame, value: str, q: float, by: list[str] | None = None) -> DataFrame:
    """(by..., threshold, n) as of ``higher_quantiles``."""
    return higher_quantiles(df, value, {"threshold": q}, by).select(*(by or []), "threshold", "n")


def linear_quantiles(df: DataFrame, value: str, named: dict[str, float], by: list[str] | None = None) -> DataFrame:
    """(by..., and a column for each named q): quantiles with linear interpolation between neighbours. One pass for all q;
    groups without a number have no row, but for one of nulls if there are no groups."""
    place = lambda q: F.lit(q) * (F.col("total") - 1)
    both = [c for name, q in named.items() for c in (_at(F.floor(place(q))).alias(f"{name}_0"), _at(F.ceil(place(q))).alias(f"{name}_1"))]
    met = _with_totals(df, value, by or []).groupBy(*(by or [])).agg(F.max("total").alias("total"), *both)
    share = lambda q: place(q) - F.floor(place(q))
    return met.select(*(by or []), *[(F.col(f"{name}_0") + (F.col(f"{name}_1") - F.col(f"{name}_0")) * share(q)).alias(name) for name, q in named.items()])


def with_quantiles(aggregated: DataFrame, df: DataFrame, named: dict[str, dict[str, float]], by: list[str]) -> DataFrame:
    """``aggregated`` (a row for each group of ``df``) with linear quantiles of several columns: {column: {name: q}}. The
    columns are one long table of values, so all quantiles of all of them are one pass and one join."""
    each = [F.struct(F.lit(c).alias("_column"), F.col(c).cast("double").alias("_value")) for c in named]
    long = df.select(*by, F.explode(F.array(*each)).alias("_m")).select(*by, "_m._column", "_m._value")
    asked = sorted({q for quantiles in named.values() for q in quantiles.values()})
    found = linear_quantiles(long, "_value", {f"_q{i}": q for i, q in enumerate(asked)}, [*by, "_column"])
    wide = [F.max(F.when(F.col("_column") == c, F.col(f"_q{asked.index(q)}"))).alias(name) for c, quantiles in named.items() for name, q in quantiles.items()]
    right = found.groupBy(*by).agg(*wide).withColumnsRenamed({k: f"_by_{k}" for k in by})
    return aggregated.join(right, [F.col(k).eqNullSafe(F.col(f"_by_{k}")) for k in by], "left").drop(*[f"_by_{k}" for k in by])


def ecdf(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """(by..., value, n, cumulative share)."""
    met = _with_totals(df, value, by or [])
    return met.select(*(by or []), F.col("_v").alias(value), "n", (F.col("cum_n") / F.col("total")).alias("share"))


def average_ranks(df: DataFrame, value: str, name: str) -> DataFrame:
    """``df`` with the column ``name``: ranks from 1, equal values sharing their mean rank."""
    counts = running(value_counts(df, value), value, ["n"]).select(F.col(value).alias("_v"), (F.col("cum_n") - (F.col("n") - 1) / 2).alias(name))
    return df.join(counts, F.col(value) == F.col("_v")).drop("_v")
