"""Registration of queries, and the tables that several of them start from.

The catalogue maps the operators to general tables: an image is an event, a vector or an order; its score is a value;
its stratum an event type; its pixels are the 8 x 8 raster of a vector of 64. Doubles are rounded to six digits.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import rounded
from ..sources.files import read_table


@dataclass(frozen=True)
class Query:
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    ids: str


CATALOGUE: dict[str, Query] = {}


def query(ids: str, sql: str | None = None):
    """Register a function (spark, sf_dir) under its own name, with the inventory ids that it covers."""

    def add(f):
        CATALOGUE[f.__name__] = Query(f, sql, ids)
        return f

    return add


def six(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: rounded(F.col(c)) for c in columns})


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image_id, kind, score, label, size, grp): events as scored images; errors are the anomalies."""
    e = read_table(spark, sf_dir, "events")
    return e.select(
        F.col("event_id").alias("image_id"), F.col("event_type").alias("kind"), F.col("value").alias("score"), (F.col("event_type") == "error").cast("int").alias("label"),
        F.get_json_object("props", "$.k").cast("int").alias("size"), (F.col("user_id") % 7).cast("int").alias("grp"), "user_id", "ts",
    )


PREDICTIONS = """pred AS (
  SELECT event_id AS image_id, event_type AS kind, value AS score, CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS label,
         CAST(json_extract_string(props, '$.k') AS INTEGER) AS size, CAST(user_id % 7 AS INTEGER) AS grp, user_id, ts FROM events)"""


def raster_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, label, score, truth): a vector's components as an 8 x 8 map; the truth is where the mirrored map is high."""
    v = read_table(spark, sf_dir, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("score"))
    return v.withColumn("truth", F.transform(F.reverse("score"), lambda x: x > 0.12))


def raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.raster import pixels

    rows = raster_rows(spark, sf_dir)
    return pixels(rows, "vec_id", {"score": "score", "truth": "truth"}, 8)


RASTER = """px AS (
  SELECT vec_id, label, CAST((i - 1) // 8 AS INTEGER) AS y, CAST((i - 1) % 8 AS INTEGER) AS x, CAST(embedding[i] AS DOUBLE) AS score,
         CAST(embedding[65 - i] AS DOUBLE) > 0.12 AS truth
  FROM embeddings, (SELECT unnest(range(1, 65)) AS i))"""
