"""Intermediate tables in a folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []
_paths: dict[int, tuple[DataFrame, str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """What ``spark.checkpoint.dir`` names; a folder of our own is used in local mode only."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not _own:
        _own.append("file://" + tempfile.mkdtemp(prefix="veldspar-"))
    return _own[0]


def _place(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def stored(df: DataFrame, instead_of: DataFrame | None = None) -> DataFrame:
    """``df`` written once as Parquet and read back; deleted when the driver's JVM ends, or when another stored table takes
    its place."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/veldspar-{uuid.uuid4().hex}"
    df.write.parquet(path)
    files, where = _place(spark, path)
    files.deleteOnExit(where)
    if (old := _paths.pop(id(instead_of), None)) is not None:
        files, where = _place(spark, old[1])
        files.delete(where, True)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[id(out)] = out, path  # the frame is kept, so its id isn't given again
    return out
