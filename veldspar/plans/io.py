"""Round trips through sources and sinks, and the stream."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import order
from ..sources import files
from ..sources.scratch import shared_dir
from .base import predictions, query


def _place(spark) -> str:
    return f"{shared_dir(spark)}/veldspar-{uuid.uuid4().hex}"


@query("S1 S6 K1", "SELECT c_custkey, c_name, c_acctbal, CASE WHEN c_nationkey % 5 = 0 THEN NULL ELSE c_mktsegment END AS c_mktsegment FROM customer")
def csv_round_trip(spark, sf_dir):
    c = files.read_table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal", F.when(F.col("c_nationkey") % 5 != 0, F.col("c_mktsegment")).alias("c_mktsegment"))
    path = _place(spark)
    files.write_csv(c, path)
    return files.read_csv(spark, path, "c_custkey long, c_name string, c_acctbal double, c_mktsegment string")


@query("K2 S4 S9 K5", "SELECT vec_id, len(embedding) AS dims, CAST(embedding[1] AS DOUBLE) AS first FROM embeddings")
def parquet_round_trip(spark, sf_dir):
    path = _place(spark)
    files.write_parquet(files.read_table(spark, sf_dir, "embeddings"), path)
    return spark.read.parquet(path).select("vec_id", F.size("embedding").cast("long").alias("dims"), F.element_at("embedding", 1).cast("double").alias("first"))


@query("S5", "SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def json_scan(spark, sf_dir):
    e = files.read_table(spark, sf_dir, "events")
    return e.select("event_id", F.from_json("props", "k int").alias("p")).select("event_id", F.col("p.k").alias("k"))


@query("extension: stream", """WITH t AS (SELECT event_type, value AS threshold FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events) WHERE i = CAST(ceil(0.95 * (n - 1)) AS BIGINT) + 1)
SELECT event_id, value > threshold AS flagged FROM events JOIN t USING (event_type)""")
def stream_flags(spark, sf_dir):
    from .. import streaming

    e = files.read_table(spark, sf_dir, "events")
    t = order.higher_quantile(predictions(spark, sf_dir), "score", 0.95, ["kind"]).select(F.col("kind").alias("event_type"), "threshold")
    stream = streaming.read_stream(spark, f"{sf_dir}/events.parquet*", e.schema)
    out, mark = _place(spark), _place(spark)
    streaming.run_to_table(streaming.score_stream(stream, t, "event_type", "value").select("event_id", "flagged"), out, mark)
    return spark.read.parquet(out).select("event_id", "flagged")
