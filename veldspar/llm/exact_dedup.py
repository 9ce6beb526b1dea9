"""Exact duplicates by distributed most-significant-digit radix partitioning of the texts' bytes.

A digit is the next run of bytes: 64 at first, then eight times as many at each level, so texts of any length end
after a few levels. A group that holds one row is final at once and leaves; a group whose digit is shorter than the
level's width has ended, and its rows are equal byte for byte. No digest takes part in deciding equality.

Each level counts its groups with map-side combining and joins the groups of two rows and more back to the rows, so a
group with a third of all rows is never gathered in a task: the joined side is one row per group, in a sort-merge join
whose hot partitions Spark splits. The first level, which all rows pass, broadcasts these rows behind a check of their
size, so that the texts needn't be shuffled to find the few that go on. Only rows that still share a prefix with
another row carry on, with only the bytes not yet consumed, in a table in the shared folder.

Defined results: null text is the empty text; a null doc_id takes part and is smaller than any other; rows that repeat
doc_id and text are members of one group, and all of them count as the row that stays (``keep_one`` drops the
repeats); an empty table gives an empty result; extra columns are ignored by ``exact_groups`` and kept by ``keep_one``,
whatever their names and types.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructType, VariantType

from .common import BROADCAST_TEXTS, durable, in_scope, small_side, table, text_or_empty

FIRST_WIDTH, GROWTH = 64, 8
#: The first level's digits of groups of two rows and more are broadcast only up to so many bytes.
BROADCAST_BYTES = 64_000_000


def _levels(rows: DataFrame, first_width: int, growth: int) -> list[DataFrame]:
    """Split rows (r_id, r_sha, r_rest binary) until groups are singleton or ended; final rows come back in parts."""
    done, width = [], first_width
    now = rows.withColumn("r_group", F.lit(None).cast("long"))
    while True:
        keyed = now.withColumn("r_digit", F.substring("r_rest", 1, width))
        groups = durable(
            keyed.groupBy("r_group", "r_digit")
            .agg(F.count("*").alias("r_n"), F.max("r_id").alias("r_keep"))
            .where("r_n > 1")
            .withColumn("r_next", F.monotonically_increasing_id())
        )
        n = groups.count()
        on = (F.col("k.r_digit") == F.col("g.r_digit")) & F.col("k.r_group").eqNullSafe(F.col("g.r_group"))
        side = small_side(groups, n if width == first_width else BROADCAST_BYTES, BROADCAST_BYTES // (width + 48)).alias("g")
        done.append(keyed.alias("k").join(side, on, "left_anti").select("r_id", F.col("r_id").alias("r_keep"), F.lit(1).cast("long").alias("r_n"), "r_sha"))
        if not n:
            return done
        met = durable(
            keyed.alias("k").join(side, on).select(
                "k.r_id", "k.r_sha", F.col("g.r_next").alias("r_group"), "g.r_n", "g.r_keep",
                (F.octet_length("k.r_digit") < width).alias("r_ended"),
                F.expr(f"substring(k.r_rest, {width + 1})").alias("r_rest"),
            )
        )
        done.append(met.where("r_ended").select("r_id", "r_keep", "r_n", "r_sha"))
        now = met.where("not r_ended").select("r_id", "r_sha", "r_rest", "r_group")
        width *= growth


def exact_groups(docs: DataFrame, first_width: int = FIRST_WIDTH, growth: int = GROWTH) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, keep_id, group_size, kept, text_sha256."""
    rows = docs.select(F.col("doc_id").alias("r_id"), F.sha2(text_or_empty().cast("binary"), 256).alias("r_sha"), text_or_empty().cast("binary").alias("r_rest"))
    return reduce(DataFrame.union, _levels(rows, first_width, growth)).select(
        F.col("r_id").alias("doc_id"), F.col("r_keep").alias("keep_id"), F.col("r_n").alias("group_size"),
        F.col("r_id").eqNullSafe(F.col("r_keep")).alias("kept"), F.col("r_sha").alias("text_sha256"),
    )


def _ordered(kind: DataType) -> bool:
    """Whether values of a type can be compared."""
    if isinstance(kind, StructType):
        return all(_ordered(f.dataType) for f in kind.fields)
    return _ordered(kind.elementType) if isinstance(kind, ArrayType) else not isinstance(kind, (MapType, VariantType))


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: of equal texts, the one with the largest doc_id."""
    found = in_scope(docs.sparkSession, lambda: exact_groups(docs.select("doc_id", "text")).where("group_size > 1").select("doc_id", "keep_id", "text_sha256").distinct())
    named = found.select(F.col("doc_id").alias("r_id"), F.col("text_sha256").alias("r_sha"), F.col("keep_id").alias("r_keep"))
    row, text_sha = F.struct(*[F.col(f"`{c}`") for c in docs.columns]), F.sha2(text_or_empty().cast("binary"), 256)
    whole = docs.select(row.alias("r_row"), F.col("doc_id").alias("r_doc"), text_sha.alias("r_text"))
    met = whole.join(small_side(named, found.count(), BROADCAST_TEXTS), F.col("r_doc").eqNullSafe(F.col("r_id")) & (F.col("r_text") == F.col("r_sha")), "left")
    single = met.where(F.col("r_sha").isNull()).select("r_row.*")
    stay = met.where(F.col("r_sha").isNotNull() & F.col("r_id").eqNullSafe(F.col("r_keep")))
    # rows that repeat doc_id and text, the least by what can be compared
    place = F.struct(*[F.col("r_row").getField(f.name) for f in docs.schema if _ordered(f.dataType)])
    return single.unionByName(stay.groupBy("r_id", "r_sha").agg(F.min_by("r_row", place).alias("r_row")).select("r_row.*"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return in_scope(spark, lambda: exact_groups(table(spark, sf_dir, "documents").select("doc_id", "text")))


SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""
