"""Plumbing shared by the training-data operators: durable intermediate tables, size-checked broadcasts, reading."""

from __future__ import annotations

import ctypes
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most rows of a few numbers that an operator broadcasts (about 64 MB as a hash table), and of rows with short texts.
BROADCAST_ROWS, BROADCAST_TEXTS = 1_000_000, 300_000

#: Bytes of an Arrow batch that goes to a Python worker, where the session doesn't say otherwise.
BATCH_BYTES = ("spark.sql.execution.arrow.maxBytesPerBatch", "4000000")

_unset: dict[str, str] = {}
_own = threading.local()


def shared_dir(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``. Only a local session, as in tests, may do without the setting."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if "dir" not in _unset:
        _unset["dir"] = "file://" + tempfile.mkdtemp(prefix="veldspar-")
    return _unset["dir"]


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _scopes() -> list[list[str]]:
    """Of this thread."""
    if not hasattr(_own, "scopes"):
        _own.scopes = []
    return _own.scopes


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Tables made durable inside are deleted at the end, but for those made with ``keep``."""
    _scopes().append([])
    try:
        yield
    finally:
        for path in _scopes().pop():
            _delete(spark, path)


def durable(df: DataFrame, keep: bool = False) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: lineage ends here and survives lost executors.

    The table is deleted at the end of the ``scope`` around it (of the one around that, with ``keep``), and at the latest
    when the driver's JVM ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/veldspar-{uuid.uuid4().hex}"
    df.write.parquet(path)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    if len(_scopes()) > keep:
        _scopes()[-1 - keep].append(path)
    return spark.read.schema(df.schema).parquet(path)


def in_scope(spark: SparkSession, make) -> DataFrame:
    """The table that ``make`` gives, written; all others that it made are deleted."""
    with scope(spark):
        return durable(make(), keep=True)


def small_side(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Mark ``df`` for broadcast only when its counted ``rows`` stay under ``limit``; beyond it Spark shuffles."""
    return F.broadcast(df) if rows <= limit else df


def arrow(df: DataFrame, made, schema: str) -> DataFrame:
    """``df.mapInArrow`` with batches of bounded bytes, whose worker hands memory back when its partition ends."""
    if not df.sparkSession.conf.get(BATCH_BYTES[0], None):
        df.sparkSession.conf.set(*BATCH_BYTES)

    def run(batches):
        try:
            yield from made(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with suppress(OSError, AttributeError):  # another C library has no such call
                ctypes.CDLL(None).malloc_trim(0)

    return df.mapInArrow(run, schema)


def unused(columns: list[str], name: str) -> str:
    """``name``, or what comes of it that no column is called, in any case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def hash_sample(df: DataFrame, key: str, most: int, tie: str, parts: int = 4096) -> DataFrame:
    """The ``most`` rows of the smallest hashes of ``key``, ties by ``tie``; all rows if there are no more.

    A count of hashes by their leading bits tells which rows can be among them, so few more than ``most`` are sorted."""
    h = F.xxhash64(key)
    # hashes are spread over all longs, so equal steps from the least one hold about as many rows
    part = F.floor((h.cast("double") + 2.0**63) / (2.0**64 / parts))
    last, left = None, most
    for r in sorted(df.groupBy(part.alias("part")).count().collect()):  # ``parts`` rows
        left -= r["count"]
        if left < 0:
            last = r["part"]
            break
    return df if last is None else df.where(part <= last).orderBy(h, tie).limit(most)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def fold_of(column: str = "doc_id", folds: int = 5) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % folds
