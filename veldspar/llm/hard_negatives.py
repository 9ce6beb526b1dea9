"""Hard negatives by exact inner products, with an orthogonal PCA rotation to discard candidates early.

Vectors are integer codes. The rotation's columns are the principal directions of a bounded sample of codes (``SAMPLE``),
strongest first; it decides only how early candidates fall, never which ones are found. With x and q rotated, the leading
components' products add up to a part of the score, and the rest is at most |x's rest| * |q's rest| by Cauchy-Schwarz.
``slack`` bounds what rounding and the rotation's defect can add, so part - rest - slack and part + rest + slack enclose the integer score.
A block of candidates is met by a block of anchors ``STEP`` components at a time; a pair is discarded as soon as its
enclosure leaves what the anchor still wants, and the survivors' scores are integer products of the codes.

Two passes over the vectors, which stay where they are: the first finds each anchor's best rows of its label (its
positives), the second for each positive the best rows of other labels in a window below its score. In either, what an
anchor wants narrows with the best scores so far in the task; a task hands on k rows of each list, and these are merged by
a window over the list. Of rows of a block with equal label and codes only the k + 1 smallest ids can matter, so a vector
that any share of rows repeat costs a block one product. Anchors go in groups of bounded size, each broadcast to a pass.

Defined results: rows with a null id, label or vector, or with a null or non-finite component, take no part; shorter
vectors count as padded with zeros; rows that repeat an id count once in a list, with their best score there, and of
repeated anchors the row of the least (label, codes) counts; a row with an anchor's own id is neither its positive nor
its negative; ties go to the smaller id; an empty table gives an empty result; extra columns are ignored. Scores are
exact while sums stay below 2**53.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import arrow, durable, scope, table
from .topk_maxscore import matrix

#: Vectors that the rotation is fitted to, at most; candidates of a block, those of the first one of a task, anchors met
#: at once, and anchors of a group (of 64 dimensions 32 MB as broadcast, and at most 25 rows each from a task).
SAMPLE, BLOCK, FIRST, MEET, GROUP = 4096, 8192, 512, 256, 32_768
#: Components added up between two looks at the bounds, and the share of live pairs below which pairs are looked at one by one.
STEP, SPARSE = 16, 0.25
NONE = np.iinfo(np.int64).min // 4
FOUND = "anchor_id long, slot int, vec_id long, score long"


def rotation(codes: np.ndarray) -> np.ndarray:
    """Orthogonal columns: the principal directions of some rows about zero, strongest first."""
    x = codes.astype(float)
    _, vectors = np.linalg.eigh(x.T @ x)
    return np.ascontiguousarray(vectors[:, ::-1])


class Rotated:
    """Rows of codes with their rotated components, and the norms of what is left after each STEP of them."""

    def __init__(self, codes: np.ndarray, turn: np.ndarray):
        dims = turn.shape[0]
        self.codes = codes[:, :dims]
        self.x = self.codes.astype(float) @ turn
        self.norm = np.sqrt((self.codes.astype(float) ** 2).sum(axis=1))
        after = np.cumsum((self.x**2)[:, ::-1], axis=1)[:, ::-1]
        # from each place on; the rest of a row is taken a little too long, never too short
        self.rest = [np.sqrt(after[:, a]) * (1 + 1e-12) if a < dims else np.zeros(len(codes)) for a in range(0, dims + STEP, STEP)]

    def take(self, rows: np.ndarray) -> Rotated:
        out = object.__new__(Rotated)
        out.codes, out.x, out.norm, out.rest = self.codes[rows], self.x[rows], self.norm[rows], [r[rows] for r in self.rest]
        return out


def slack_of(turn: np.ndarray) -> float:
    """How far the product of two rotated rows may be from that of the rows, as a share of the product of their norms."""
    dims = turn.shape[0]
    return float(np.abs(turn @ turn.T - np.eye(dims)).sum()) + 8 * (dims + 2) ** 1.5 * np.finfo(float).eps


def survivors(q: Rotated, x: Rotated, low: np.ndarray, high: np.ndarray, allowed: np.ndarray, slack: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(row of q, row of x, integer score) of the allowed pairs with low <= score <= high (by row of q); and how many
    products of components were formed."""
    dims, read = q.x.shape[1], 0
    off = slack * q.norm[:, None] * x.norm[None]
    part, live, a = np.zeros(allowed.shape), allowed & (low <= high)[:, None], 0
    while a < dims and live.mean() > SPARSE:  # whole blocks
        b = min(dims, a + STEP)
        part += q.x[:, a:b] @ x.x[:, a:b].T
        read += part.size * (b - a)
        wide = q.rest[b // STEP if b % STEP == 0 else -1][:, None] * x.rest[b // STEP if b % STEP == 0 else -1][None] + off
        live &= (part + wide >= low[:, None]) & (part - wide <= high[:, None])
        a = b
    i, j = np.nonzero(live)
    part, off = part[i, j], off[i, j]
    while a < dims and len(i):  # pair by pair
        b = min(dims, a + STEP)
        part = part + np.einsum("ij,ij->i", q.x[i, a:b], x.x[j, a:b])
        read += len(i) * (b - a)
        wide = q.rest[b // STEP if b % STEP == 0 else -1][i] * x.rest[b // STEP if b % STEP == 0 else -1][j] + off
        on = (part + wide >= low[i]) & (part - wide <= high[i])
        i, j, part, off, a = i[on], j[on], part[on], off[on], b
    score = np.empty(len(i), dtype=np.int64)
    for c in range(0, len(i), 1 << 16):
        score[c : c + (1 << 16)] = np.einsum("ij,ij->i", q.codes[i[c : c + (1 << 16)]], x.codes[j[c : c + (1 << 16)]])
    on = (score >= low[i]) & (score <= high[i])
    return i[on], j[on], score[on], read


@dataclass
class Wanted:
    """Anchors and their lists: list ``s`` of anchor ``i`` takes the k best candidates with low[i, s] <= score <= high[i, s],
    of the anchor's label or of all others."""

    ids: np.ndarray
    labels: np.ndarray
    codes: np.ndarray
    low: np.ndarray
    high: np.ndarray
    same: bool
    k: int


class Lists:
    """The best candidates of each list so far."""

    def __init__(self, wanted: Wanted, turn: np.ndarray):
        self.wanted, self.turn, self.slack = wanted, turn, slack_of(turn)
        self.q = Rotated(matrix_of(wanted.codes, turn.shape[0]), turn)
        shape = (*wanted.low.shape, wanted.k)
        self.ids, self.scores = np.full(shape, -1, dtype=np.int64), np.full(shape, NONE, dtype=np.int64)
        self.pairs = self.read = 0

    def add(self, ids: np.ndarray, labels: np.ndarray, codes: np.ndarray) -> None:
        """Candidates of a block."""
        w, k = self.wanted, self.wanted.k
        codes = matrix_of(codes, self.turn.shape[0])
        rows = np.ascontiguousarray(np.column_stack([labels, codes])).view(np.dtype((np.void, 8 * (codes.shape[1] + 1)))).ravel()
        _, first, of = np.unique(rows, return_index=True, return_inverse=True)
        # only the k + 1 smallest ids of equal rows can be in a list
        order = np.lexsort((ids, of))
        new = np.concatenate((np.ones(min(1, len(order)), bool), (of[order][1:] != of[order][:-1]) | (ids[order][1:] != ids[order][:-1])))
        order = order[new]
        begin = np.searchsorted(of[order], np.arange(len(first) + 1))
        place = np.arange(len(order)) - begin[of[order]]
        kept = order[place <= k]
        held = np.searchsorted(of[kept], np.arange(len(first) + 1))
        x, x_labels = Rotated(codes[first], self.turn), labels[first]
        for a in range(0, len(w.ids), MEET):
            some = np.arange(a, min(len(w.ids), a + MEET))
            least = np.maximum(w.low[some], self.scores[some, :, -1])
            low, high = np.where(least <= w.high[some], least, NONE * -1).min(axis=1), w.high[some].max(axis=1)
            allowed = (w.labels[some][:, None] == x_labels[None]) == w.same
            i, j, score, read = survivors(self.q.take(some), x, low.astype(float), high.astype(float), allowed, self.slack)
            self.pairs += int(allowed.sum()) * codes.shape[1]
            self.read += read
            if len(i):
                times = held[j + 1] - held[j]
                at = np.repeat(held[j], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
                self._join(some[np.repeat(i, times)], ids[kept[at]], np.repeat(score, times))

    def _join(self, anchor: np.ndarray, ids: np.ndarray, score: np.ndarray) -> None:
        w, k = self.wanted, self.wanted.k
        other = ids != w.ids[anchor]
        anchor, ids, score = anchor[other], ids[other], score[other]
        for s in range(w.low.shape[1]):
            on = (score >= w.low[anchor, s]) & (score <= w.high[anchor, s]) & (score >= self.scores[anchor, s, -1])
            if not on.any():
                continue
            touched = np.unique(anchor[on])
            a = np.concatenate([anchor[on], np.repeat(touched, k)])
            v = np.concatenate([ids[on], self.ids[touched, s].ravel()])
            c = np.concatenate([score[on], self.scores[touched, s].ravel()])
            real = c > NONE
            a, v, c = a[real], v[real], c[real]
            order = np.lexsort((-c, v, a))  # of an id the best score
            a, v, c = a[order], v[order], c[order]
            one = np.concatenate(([True], (a[1:] != a[:-1]) | (v[1:] != v[:-1])))
            a, v, c = a[one], v[one], c[one]
            order = np.lexsort((v, -c, a))
            a, v, c = a[order], v[order], c[order]
            place = np.arange(len(a)) - np.searchsorted(a, a)
            best = place < k
            self.ids[touched, s], self.scores[touched, s] = -1, NONE
            self.ids[a[best], s, place[best]], self.scores[a[best], s, place[best]] = v[best], c[best]

    def rows(self) -> pa.RecordBatch:
        i, s, p = np.nonzero(self.scores > NONE)
        return pa.RecordBatch.from_arrays([pa.array(self.wanted.ids[i]), pa.array(s.astype(np.int32)), pa.array(self.ids[i, s, p]), pa.array(self.scores[i, s, p])], ["anchor_id", "slot", "vec_id", "score"])


def matrix_of(codes: np.ndarray, dims: int) -> np.ndarray:
    """With ``dims`` columns: missing ones are zeros."""
    return codes[:, :dims] if codes.shape[1] >= dims else np.pad(codes, ((0, 0), (0, dims - codes.shape[1])))


def _pass(rows: DataFrame, wanted: Wanted, turn: np.ndarray, block: int) -> DataFrame:
    """The best of each task, of candidates (vec_id, label, codes)."""
    held = rows.sparkSession.sparkContext.broadcast((wanted, turn))

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists, waiting, n, most = Lists(*held.value), [], 0, FIRST

        def flush() -> None:
            whole = pa.Table.from_batches(waiting).combine_chunks()
            lists.add(whole.column(0).to_numpy(), whole.column(1).to_numpy(), matrix(whole.column(2)))

        for batch in batches:
            a = 0
            while a < batch.num_rows:
                waiting.append(batch.slice(a, most - n))
                a, n = a + waiting[-1].num_rows, n + waiting[-1].num_rows
                if n >= most:
                    flush()
                    waiting, n, most = [], 0, block
        if waiting:
            flush()
        yield lists.rows()

    return arrow(rows, made, FOUND)


def _merged(found: DataFrame, k: int) -> DataFrame:
    """The k best of each list, with their rank."""
    place = F.row_number().over(Window.partitionBy("anchor_id", "slot").orderBy(F.desc("score"), "vec_id"))
    return found.groupBy("anchor_id", "slot", "vec_id").agg(F.max("score").alias("score")).withColumn("rank", place.cast("int")).where(F.col("rank") <= k)


def labelled_codes(vectors: DataFrame, scale: int, label: Column) -> DataFrame:
    """(vec_id, label, codes) of the rows that take part."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    there = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()
    codes = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long"))
    return vectors.where(there & finite).select(F.col("vec_id").cast("long"), label.cast("long").alias("label"), codes.alias("codes"))


def mine(rows: DataFrame, is_anchor: Column, k: int = 5, positives: int = 5, percent: int = 80, group: int = GROUP, block: int = BLOCK) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of rows (vec_id, label, codes): for each
    anchor's best ``positives`` of its label the best ``k`` of other labels that score at most as high, and at least
    ``percent`` of it."""
    spark = rows.sparkSession
    nothing = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    with scope(spark):
        anchors = durable(rows.where(is_anchor).groupBy("vec_id").agg(F.min(F.struct("label", "codes")).alias("m")).select("vec_id", "m.label", "m.codes"))
        n = anchors.count()
        if not n:
            return nothing
        sample = matrix(rows.orderBy(F.xxhash64("vec_id", "codes")).limit(SAMPLE).select("codes").toArrow()["codes"])
        dims = max(sample.shape[1], anchors.agg(F.max(F.size("codes"))).first()[0])  # anchors have no other components
        turn = rotation(matrix_of(sample, max(1, dims)))
        groups = -(-n // group)
        dealt = anchors.withColumn("g", F.pmod(F.xxhash64("vec_id"), F.lit(groups)))
        done = []
        for g in range(groups):
            found = dealt.where(F.col("g") == g).drop("g").orderBy("vec_id").toArrow()
            if not found.num_rows:
                continue
            ids, labels, codes = found["vec_id"].to_numpy(), found["label"].to_numpy(), matrix(found["codes"])
            any_score = np.full((len(ids), 1), -NONE)
            near = _merged(durable(_pass(rows, Wanted(ids, labels, codes, 1 - any_score, any_score, True, positives), turn, block)), positives)
            best = near.select("anchor_id", "rank", "vec_id", "score").toArrow()  # ``positives`` rows an anchor
            at = (np.searchsorted(ids, best["anchor_id"].to_numpy()), best["rank"].to_numpy() - 1)
            positive, top = np.full((len(ids), positives), -1, dtype=np.int64), np.full((len(ids), positives), NONE, dtype=np.int64)
            positive[at], top[at] = best["vec_id"].to_numpy(), best["score"].to_numpy()
            low = np.where(top > NONE, -(-percent * top // 100), -NONE)
            lists = _merged(durable(_pass(rows, Wanted(ids, labels, codes, low, top, False, k), turn, block)), k)
            of = spark.createDataFrame(pa.table({"anchor_id": best["anchor_id"], "slot": pa.array(at[1].astype(np.int32)), "positive_id": best["vec_id"], "positive_score": best["score"]}))
            done.append(durable(lists.join(of, ["anchor_id", "slot"]).select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")), keep=True))
        return reduce(DataFrame.union, done)


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(labelled_codes(vectors, 256, label), F.col("vec_id") % 100 == 0)


SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         CAST(list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS DOUBLE[]) AS c
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, v.vec_id, a.label = v.label AS same, CAST(list_dot_product(a.c, v.c) AS BIGINT) AS score
  FROM v a JOIN v ON v.vec_id <> a.vec_id WHERE a.vec_id % 100 = 0
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
), n AS (
  SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
  FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
  WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)
)
SELECT * FROM n WHERE rank <= 5
"""
