"""Scans with declared schemas, and sinks that write once."""

from __future__ import annotations

import hashlib
import json

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def read_csv(spark: SparkSession, path: str, schema: str, blank_as_null: bool = True) -> DataFrame:
    """A CSV with a header and a declared schema; blanks are null, or stay empty where strings are asked for."""
    reader = spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("mode", "FAILFAST")
    df = reader.option("nullValue", "").option("emptyValue", "").csv(path)
    return df if blank_as_null else df.fillna("")


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Whole documents."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def read_images(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, height, width, channels, data) of images that Spark decodes; data are rows of blue, green, red bytes (or of
    grey ones). Files that aren't images are left out; ``undecoded`` names them."""
    images = spark.read.format("image").option("dropInvalid", True).option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    return images.select(F.col("image.origin").alias("path"), F.col("image.height").alias("height"), F.col("image.width").alias("width"), F.col("image.nChannels").alias("channels"), F.col("image.data").alias("data"))


def read_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, length, sha256) of files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"))


def undecoded(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path) of files that Spark can't decode as images."""
    bare = F.regexp_replace("path", "^file:/+", "/")
    return read_files(spark, path, pattern).select(bare.alias("path")).join(read_images(spark, path, pattern).select(bare.alias("path")), "path", "left_anti")


def _hadoop(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    files, where = _hadoop(spark, path)
    return files.exists(where)


def create(spark: SparkSession, path: str, text: str) -> None:
    """A small file in the file system that the path names, which must not be there yet."""
    files, where = _hadoop(spark, path)
    try:
        out = files.create(where, False)
    except Py4JJavaError as e:
        if "FileAlreadyExistsException" in str(e.java_exception.getClass().getName()) or "already exists" in str(e.java_exception):
            raise FileExistsError(path) from None
        raise
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def delete(spark: SparkSession, path: str) -> None:
    files, where = _hadoop(spark, path)
    files.delete(where, True)


def read_text(spark: SparkSession, path: str) -> str:
    """A small file's text."""
    return spark.read.text(path, wholetext=True).first()[0]


def write_csv(df: DataFrame, path: str) -> None:
    """Doubles print as the shortest text that reads back equal."""
    df.write.mode("errorifexists").option("header", True).option("lineSep", "\n").csv(path)


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").parquet(path)


def _json(value) -> str:
    return json.dumps(value, allow_nan=False, sort_keys=True, indent=1)


def write_once(spark: SparkSession, path: str, value) -> None:
    """JSON without NaN, to a file that must not exist."""
    create(spark, path, _json(value))


def write_same(spark: SparkSession, path: str, value) -> None:
    """As ``write_once``, but equal content may be there already; other content is an error."""
    if not exists(spark, path):
        write_once(spark, path, value)
    elif hashlib.sha256(read_text(spark, path).encode()).digest() != hashlib.sha256(_json(value).encode()).digest():
        raise ValueError(f"{path} has other content")
