"""Structured Streaming: scores of a stream of records against fixed thresholds, micro-batch by micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalar import strictly_above


def score_stream(stream: DataFrame, thresholds: DataFrame, key: str, value: str) -> DataFrame:
    """A stream of records with threshold and flagged; thresholds are a static table (key, threshold), which Spark broadcasts
    if its size allows."""
    return stream.join(thresholds, key, "left").withColumn("flagged", strictly_above(F.col(value), F.col("threshold")))


def flag_rates(stream: DataFrame, time: str, key: str, value: str, thresholds: DataFrame, width: str = "1 day", late: str = "1 day") -> DataFrame:
    """Counts of records and flags per window and key; records later than the watermark are dropped."""
    scored = score_stream(stream.withWatermark(time, late), thresholds, key, value)
    rows = scored.groupBy(F.window(time, width).alias("w"), key).agg(F.count("*").alias("n"), F.count_if("flagged").alias("n_flagged"))
    return rows.select(F.col("w.start").alias("window_start"), key, "n", "n_flagged")


def run_to_table(frame: DataFrame, path: str, checkpoint: str) -> None:
    """Process all that is there into a Parquet table, exactly once per batch."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    query = frame.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
    query.awaitTermination()


def read_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)
