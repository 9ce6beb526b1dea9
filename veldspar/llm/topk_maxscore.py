"""Exact top-k inner products by MaxScore over postings of shards of vectors.

Every dimension is a query term, and a shard holds a postings list for each: the codes of its vectors in that dimension.
With ``lo`` and ``hi`` the shard's least and greatest code in it, a vector's code x adds ``|q| * (x - lo)`` where q > 0
and ``|q| * (hi - x)`` where q < 0 to a constant of the query, so each term's score is at least 0 and at most
``|q| * (hi - lo)``. Terms are ordered by that bound. Given the k-th best score so far, the non-essential terms are the
largest set of lowest bounds whose sum stays below it: they can't carry a vector alone. Only the essential terms'
postings are traversed; the others are probed, strongest first, for the vectors that are still competitive, until none
is. The k-th best score of a query rises from shard to shard of a task, and a task hands on k rows a query.

Queries go in groups of bounded size, each broadcast to one pass over the vectors, which stay where they are: only
results are shuffled, and merged by a window over the query.

Defined results: vectors null, or holding null or non-finite components, take no part; shorter vectors count as padded
with zeros and an empty one scores 0; a row isn't a candidate of a query with its own vec_id; rows that repeat a
vec_id count once, with their best score; a null vec_id takes no part; ties go to the smaller vec_id; an empty table
gives an empty result; extra columns are ignored. Scores are exact while sums stay within 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import arrow, durable, scope, table

#: Vectors of a shard, those scored in full to begin with, dimensions probed at once, and queries of a group (with 64
#: dimensions 32 MB as broadcast, and 20 MB of results in a task).
SHARD, FIRST, PROBE, GROUP = 8192, 512, 8, 65_536
FOUND = "query_id long, vec_id long, score long"
NONE = np.iinfo(np.int64).min


def codes_of(vectors: DataFrame, scale: int) -> DataFrame:
    """(vec_id, codes): floor(scale * x) of the vectors that take part."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & finite).select(
        F.col("vec_id").cast("long"), F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("codes")
    )


def matrix(codes: pa.ListArray | pa.ChunkedArray, dims: int = 0) -> np.ndarray:
    """Codes by row, padded with zeros to the longest one, and to ``dims`` at least."""
    codes = codes.combine_chunks() if isinstance(codes, pa.ChunkedArray) else codes
    sizes = codes.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(sizes), max(dims, int(sizes.max(initial=0)))), dtype=np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = codes.flatten().to_numpy()
    return out


class Postings:
    """A shard: for each dimension the codes of all its vectors, with their least and greatest."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, most: int):
        """``most``: the greatest sum of absolute codes of a query."""
        reach = most * int(np.abs(x).max(initial=0)) * 2 + 1
        kind = np.float32 if reach < 2**24 else np.float64 if reach < 2**53 else np.int64
        self.ids, self.lists = ids, np.ascontiguousarray(x.T).astype(kind)
        self.lo, self.hi = x.min(axis=0), x.max(axis=0)
        #: entries of postings lists, and how many of them were read
        self.held, self.read = 0, 0

    def beaten(self, q: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(vectors, scores) of all that score ``least`` or more."""
        n = len(self.ids)
        self.held += q.size * n
        bound = np.abs(q) * (self.hi - self.lo)
        order = np.argsort(bound, kind="stable")  # weakest first
        fixed = int(np.where(q > 0, q * self.lo, q * self.hi).sum())
        weak = int((np.cumsum(bound[order]) < least - fixed).sum()) if least > NONE else 0
        kind = self.lists.dtype
        essential = order[weak:]
        score = q[essential].astype(kind) @ self.lists[essential]
        self.read += len(essential) * n
        most = np.maximum(q * self.lo, q * self.hi)[order]
        open_ = int(most[:weak].sum())
        live = np.flatnonzero(score + open_ >= least) if least > NONE else np.arange(n)
        score = score[live]
        for end in range(weak, 0, -PROBE):
            if not len(live):
                break
            some = order[max(0, end - PROBE) : end]
            # a gather of some vectors costs about as much as reading the lists of all of them in a row
            lists = self.lists[some][:, live] if 2 * len(live) > n else self.lists[some[:, None], live]
            score = score + q[some].astype(kind) @ lists
            self.read += len(some) * len(live)
            open_ -= int(most[max(0, end - PROBE) : end].sum())
            if least > NONE:
                on = np.flatnonzero(score + open_ >= least)
                live, score = live[on], score[on]
        return live, score.astype(np.int64)


class Best:
    """The k best vectors of each query so far."""

    def __init__(self, q_ids: np.ndarray, q: np.ndarray, k: int):
        self.q_ids, self.q, self.k = q_ids, q, k
        self.ids: list[np.ndarray] = [np.zeros(0, np.int64)] * len(q_ids)
        self.scores: list[np.ndarray] = [np.zeros(0, np.int64)] * len(q_ids)

    def add(self, ids: np.ndarray, x: np.ndarray) -> tuple[int, int]:
        """(entries, those read) of the postings of some vectors, whose best join."""
        if x.shape[1] < self.q.shape[1]:
            x = np.pad(x, ((0, 0), (0, self.q.shape[1] - x.shape[1])))
        most, held, read = int(np.abs(self.q).sum(axis=1).max(initial=0)), 0, 0
        begun = all(len(s) == self.k for s in self.scores)
        cuts = [0, len(ids)] if begun or len(ids) <= 2 * FIRST else [0, FIRST, len(ids)]
        for a, b in zip(cuts[:-1], cuts[1:]):
            # what queries have no dimension for adds nothing
            shard = Postings(ids[a:b], x[a:b, : self.q.shape[1]], most)
            for i in range(len(self.q_ids)):
                least = int(self.scores[i][-1]) if len(self.scores[i]) == self.k else NONE
                at, score = shard.beaten(self.q[i], least)
                if len(at):
                    self._join(i, shard.ids[at], score)
            held, read = held + shard.held, read + shard.read
        return held, read

    def _join(self, i: int, ids: np.ndarray, score: np.ndarray) -> None:
        others = ids != self.q_ids[i]
        ids, score = np.concatenate([self.ids[i], ids[others]]), np.concatenate([self.scores[i], score[others]])
        if len(ids) > 8 * self.k:  # more of an id than the k best of it can't matter, so few need sorting
            repeats = len(ids) - len(np.unique(ids))
            if (want := self.k + repeats) < len(ids):
                some = score >= np.partition(score, len(score) - want)[len(score) - want]
                ids, score = ids[some], score[some]
        order = np.lexsort((ids, -score))
        ids, score = ids[order], score[order]
        _, first = np.unique(ids, return_index=True)
        first = np.sort(first)[: self.k]
        self.ids[i], self.scores[i] = ids[first], score[first]

    def rows(self) -> pa.RecordBatch:
        sizes = [len(x) for x in self.ids]
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(self.q_ids, sizes)), pa.array(np.concatenate([*self.ids, np.zeros(0, np.int64)])), pa.array(np.concatenate([*self.scores, np.zeros(0, np.int64)]))], ["query_id", "vec_id", "score"])


def _searched(codes: DataFrame, group: DataFrame, k: int, shard: int) -> DataFrame:
    """The k best vectors of each task for the queries of a group, which is collected: GROUP bounds it."""
    found = group.toArrow()
    asked = codes.sparkSession.sparkContext.broadcast((found["vec_id"].to_numpy(), matrix(found["codes"])))

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, waiting, rows = Best(*asked.value, k), [], 0

        def flush() -> None:
            whole = pa.Table.from_batches(waiting).combine_chunks()
            best.add(whole.column(0).to_numpy(), matrix(whole.column(1)))

        for batch in batches:
            for a in range(0, batch.num_rows, shard):
                waiting.append(batch.slice(a, shard))
                rows += waiting[-1].num_rows
                if rows >= shard:
                    flush()
                    waiting, rows = [], 0
        if waiting:
            flush()
        yield best.rows()

    return arrow(codes, made, FOUND)


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: int = 64, shard: int = SHARD, group: int = GROUP) -> DataFrame:
    """query_id, rank, vec_id, score of each query's k best among the other rows of ``vectors`` (vec_id, embedding)."""
    spark = vectors.sparkSession
    codes = codes_of(vectors, scale)
    with scope(spark):
        asked = durable(codes.where(is_query).distinct())
        n = asked.count()
        groups = max(1, -(-n // group))
        dealt = asked.withColumn("g", F.pmod(F.xxhash64("vec_id", "codes"), F.lit(groups))) if groups > 1 else asked.withColumn("g", F.lit(0))
        parts = [_searched(codes, dealt.where(F.col("g") == i).select("vec_id", "codes"), k, shard) for i in range(groups if n else 0)]
        if not parts:
            return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
        found = durable(reduce(DataFrame.union, parts), keep=True)
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", place.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op9_topk_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), F.col("vec_id") % 20 == 0)


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS c FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, v.vec_id, CAST(list_dot_product(CAST(q.c AS DOUBLE[]), CAST(v.c AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v ON v.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0
)
SELECT query_id, CAST(row_number() OVER best AS INTEGER) AS rank, vec_id, score FROM s
WINDOW best AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER best <= 20
"""
