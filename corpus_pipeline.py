"""The corpus pipeline: quality, exact copies, near copies, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet and reread as the next one's
docs. All but the last return the columns of documents. Labels are joined on doc_id, so a stage's own input decides
which of them it learns from.

Defined results: an empty table passes through every stage; null texts count as empty, and are kept as null until
packing; extra columns of any name and type are carried as far as the personal-data stage; rows that repeat doc_id and
text are one document from the exact stage on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veldspar.llm import exact_dedup, jaccard_join, packing, pii_infotheory, quality_cotrain
from veldspar.llm.common import durable, scope, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier rejects go."""
    return quality_cotrain.keep_good(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the largest doc_id stays."""
    return exact_dedup.keep_one(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles at a similarity of 0.8 or more, the one with the least doc_id stays."""
    return jaccard_join.keep_representatives(docs, k=5, percent=80)


def personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced, and so are the terms that reveal it."""
    return pii_infotheory.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences: one row per piece of a document."""
    return packing.packed_digests(docs)


STAGES = [("quality_cotrain", quality), ("exact_dedup", exact), ("ngram_jaccard_join", near), ("pii_infotheory", personal), ("harmonic_packing", pack)]

#: SQL can't express the stages that train a classifier or make token ids.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    with scope(spark):
        docs = table(spark, sf_dir, "documents")
        for _, stage in STAGES[:-1]:
            docs = durable(stage(spark, docs, sf_dir))
        return durable(STAGES[-1][1](spark, docs, sf_dir), keep=True)
