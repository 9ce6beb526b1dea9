"""Document quality by co-training two views.

The content view describes the text: shares of kinds of characters, lengths and repetition of words and lines. The
metadata view describes the record: language and source, hashed into ``LANGS`` and ``SOURCES`` features, and the stated
length. Both start from the same bounded sample of labelled documents (``LABELLED``); in each round either view labels
the unlabelled documents of the whole table that it is surest of (at most ``PER_ROUND``), and hands them to the other
view's training set, weighing less than true labels. At the end each view's log-odds are calibrated and combined by a
logistic curve fitted to predictions for labelled documents that the views had not seen (two halves, each scored by
views trained on the other). The fitted views then score every document.

The two halves and the whole sample are trained side by side, so that a round is one pass over the views of all
documents, a small table made once; only its surest rows come to the driver.

Defined results: null and empty texts are described by zeros; null metadata is a value of its own; repeated rows are
scored each; a null doc_id takes part; without both labels in the sample every score is 1 and nothing is rejected; an
empty table gives an empty result; ``keep_good`` keeps extra columns of any type and name.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import textbytes as tb
from .common import arrow, durable, hash_sample, scope, table, unused
from .toxicity import logistic

LABELLED, ROUNDS, PER_ROUND, PSEUDO_WEIGHT, THRESHOLD = 12_000, 4, 400, 0.3, 0.5
#: Log-odds from which on a view is sure of a document.
SURE = 2.0
LANGS, SOURCES = 16, 64

_KINDS = ["lower", "upper", "digit", "blank", "newline", "stop", "mark", "wide", "other"]


def _kind() -> np.ndarray:
    out = np.full(256, _KINDS.index("other"), dtype=np.int64)
    for name, chars in (("lower", range(97, 123)), ("upper", range(65, 91)), ("digit", range(48, 58)), ("blank", [32, 9]), ("newline", [10, 13]), ("stop", map(ord, ".,;:")), ("mark", map(ord, "!?")), ("wide", range(128, 256))):
        out[list(chars)] = _KINDS.index(name)
    return out


KIND = _kind()
CONTENT = len(_KINDS) + 7


def describe(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The content view of some texts: one row of CONTENT numbers each."""
    rows = len(offsets) - 1
    share = np.zeros(rows * len(_KINDS))
    for a in range(0, len(data), tb.STEP_BYTES):
        row = np.repeat(np.arange(rows), np.diff(np.clip(offsets, a, a + tb.STEP_BYTES)))
        share += np.bincount(row * len(_KINDS) + KIND[data[a : a + tb.STEP_BYTES]], minlength=len(share))
    share = share.reshape(rows, len(_KINDS)) / np.maximum(1, np.diff(offsets))[:, None]
    w = tb.words(data, offsets)
    n = np.diff(w.first)
    many = np.maximum(1, n)
    word_row = np.repeat(np.arange(rows), n)
    size = (w.end - w.start).astype(float)
    mean = np.bincount(word_row, weights=size, minlength=rows) / many
    spread = np.sqrt(np.maximum(0, np.bincount(word_row, weights=size**2, minlength=rows) / many - mean**2))
    order = np.lexsort((w.name, word_row))
    name, at = w.name[order], word_row[order]
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(name)), bool), (name[1:] != name[:-1]) | (at[1:] != at[:-1]))))
    times = np.diff(np.append(first, len(name)))
    distinct = np.bincount(at[first], minlength=rows)
    top = np.zeros(rows)
    np.maximum.at(top, at[first], times)
    same = np.zeros(rows)
    if len(w.name) > 1:
        again = (w.name[1:] == w.name[:-1]) & (word_row[1:] == word_row[:-1])
        same = np.bincount(word_row[1:][again], minlength=rows) / many
    tail = np.bincount(word_row, weights=(KIND[data[w.end - 1]] == _KINDS.index("other")).astype(float), minlength=rows) / many if len(w.end) else np.zeros(rows)
    more = np.stack([mean / 10, spread / 10, distinct / many, distinct / np.sqrt(many) / 10, top / many, same, tail], axis=1)
    return np.hstack([share, more])


def metadata_columns(docs: DataFrame) -> list[Column]:
    """Small hash buckets of language and source, and the logarithm of the stated length."""
    bucket = lambda c, n: F.pmod(F.xxhash64(F.coalesce(F.col(c).cast("string"), F.lit(""))), F.lit(n)).cast("int")
    return [bucket("lang", LANGS).alias("m_lang"), bucket("source", SOURCES).alias("m_source"), F.log1p(F.greatest(F.lit(0.0), F.coalesce(F.col("n_chars").cast("double"), F.lit(0.0)))).alias("m_chars")]


def _record(lang: np.ndarray, source: np.ndarray, chars: np.ndarray) -> np.ndarray:
    out = np.zeros((len(lang), LANGS + SOURCES + 2))
    at = np.arange(len(lang))
    out[at, lang] = 1
    out[at, LANGS + source] = 1
    out[:, -2], out[:, -1] = chars / 10, (chars / 10) ** 2
    return out


def odds(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return np.clip(x @ w[:-1] + w[-1], -30, 30)


#: The surest documents of each (training, teacher, label): their rows, and their two views.
Picks = dict[tuple[int, int, int], tuple[np.ndarray, list[np.ndarray]]]


def cotrain(trainings: list[tuple[list[np.ndarray], np.ndarray]], surest: Callable[[list[list[np.ndarray]]], Picks], rounds: int = ROUNDS) -> list[list[np.ndarray]]:
    """Weights of each view's logistic regression after the views have taught each other, for each training (views,
    labels). ``surest`` gives the unlabelled documents that views of some weights are surest of."""
    given: list[list[dict]] = [[{}, {}] for _ in trainings]
    weights = [[logistic(x, y) for x in views] for views, y in trainings]
    for _ in range(rounds):
        for (t, teacher, label), (rows, views) in sorted(surest(weights).items()):
            given[t][1 - teacher].update((int(r), (label, x)) for r, x in zip(rows, views[1 - teacher]))
        for t, (views, y) in enumerate(trainings):
            for v in (0, 1):
                if more := list(given[t][v].values()):
                    weights[t][v] = logistic(
                        np.vstack([views[v], np.stack([x for _, x in more])]), np.concatenate([y, [float(label) for label, _ in more]]),
                        np.concatenate([np.ones(len(y)), np.full(len(more), PSEUDO_WEIGHT)]),
                    )
    return weights


def quotas(y: np.ndarray, each: int = PER_ROUND) -> tuple[int, int]:
    """How many documents of either label a view hands on in a round."""
    return max(1, int(each * (1 - y.mean()))), max(1, int(each * y.mean()))


def surest_of(z: np.ndarray, rows: np.ndarray, label: int, most: int) -> np.ndarray:
    """Places of the ``most`` log-odds that are surest of a label, ties to the smaller row."""
    key = -z if label else z
    sure = np.flatnonzero(key < -SURE)
    return sure[np.lexsort((rows[sure], key[sure]))][:most]


class Model:
    """Two views and their combination; with no views all documents score 1."""

    def __init__(self, views: list[np.ndarray] | None = None, curves: list[np.ndarray] | None = None, join: np.ndarray | None = None):
        self.views, self.curves, self.join = views, curves, join

    def scores(self, content: np.ndarray, record: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if self.views is None:
            return (np.ones(len(content)),) * 3
        z = [odds(odds(x, w)[:, None], c) for x, w, c in zip((content, record), self.views, self.curves)]
        p = lambda v: 1 / (1 + np.exp(-v))
        return p(z[0]), p(z[1]), p(odds(np.stack(z, axis=1), self.join))


def fit(content: np.ndarray, record: np.ndarray, y: np.ndarray, surest: Callable[[list[list[np.ndarray]], list[tuple[int, int]]], Picks]) -> Model:
    if len(np.unique(y)) < 2 or min((y == 0).sum(), (y == 1).sum()) < 4:
        return Model()
    views = [content, record]
    half = np.zeros(len(y), dtype=bool)
    for label in (0, 1):
        half[np.flatnonzero(y == label)[::2]] = True
    parts = [~half, half, np.ones(len(y), dtype=bool)]
    most = [quotas(y[part]) for part in parts]
    weights = cotrain([([x[part] for x in views], y[part]) for part in parts], lambda w: surest(w, most))
    unseen = [np.zeros(len(y)), np.zeros(len(y))]
    for part, trained_ in zip((half, ~half), weights):
        for v in (0, 1):
            unseen[v][part] = odds(views[v][part], trained_[v])
    curves = [logistic(z[:, None], y) for z in unseen]
    calibrated = np.stack([odds(z[:, None], c) for z, c in zip(unseen, curves)], axis=1)
    return Model(weights[2], curves, logistic(calibrated, y))


VIEWS = "m_lang int, m_source int, m_chars double, i long, content array<double>"


def views_of(docs: DataFrame) -> DataFrame:
    """m_lang, m_source, m_chars, i (doc_id) and content (array) of each row."""

    def made(batches):
        for batch in batches:
            for part, data, offsets in tb.steps(batch, "text"):
                x = describe(data, offsets)
                content = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * CONTENT), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([*[part.column(i) for i in range(1, 5)], content], ["m_lang", "m_source", "m_chars", "i", "content"])

    return arrow(docs.select("text", *metadata_columns(docs), F.col("doc_id").cast("long").alias("i")), made, VIEWS)


def _both(found: pa.Table | pa.RecordBatch) -> list[np.ndarray]:
    """The two views of some rows."""
    content = found["content"]
    content = content.combine_chunks() if isinstance(content, pa.ChunkedArray) else content
    return [content.flatten().to_numpy(zero_copy_only=False).reshape(-1, CONTENT), _record(*(found[c].to_numpy() for c in ("m_lang", "m_source", "m_chars")))]


def _surest(pool: DataFrame, weights: list[list[np.ndarray]], most: list[tuple[int, int]]) -> Picks:
    """Over the rows (row, and those of ``views_of``) of a table: each task hands on its surest rows, and the surest of
    all are found in two steps, so that no task sorts all of them."""
    held = pool.sparkSession.sparkContext.broadcast((weights, most))
    lists = [(t, v, label) for t in range(len(weights)) for v in (0, 1) for label in (0, 1)]

    def made(batches):
        best: dict[int, pa.Table] = {}
        for batch in batches:
            views, rows = _both(batch), batch.column(0).to_numpy()
            for n, (t, v, label) in enumerate(lists):
                z = odds(views[v], held.value[0][t][v])
                at = surest_of(z, rows, label, held.value[1][t][label])
                own = pa.Table.from_batches([batch.take(pa.array(at))]).append_column("key", pa.array(z[at] * (1 - 2 * label)))
                if n in best:
                    own = pa.concat_tables([best[n], own])
                    order = np.lexsort((own["row"].to_numpy(), own["key"].to_numpy()))[: held.value[1][t][label]]
                    own = own.take(pa.array(order)).combine_chunks()
                best[n] = own
        for n, own in best.items():
            yield from own.append_column("list", pa.array(np.full(own.num_rows, n, dtype=np.int32))).to_batches()

    found = arrow(pool.select("row", "m_lang", "m_source", "m_chars", "content"), made, "row long, m_lang int, m_source int, m_chars double, content array<double>, key double, list int")
    for by in (["list", F.pmod(F.xxhash64("row"), F.lit(64))], ["list"]):
        found = found.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy("key", "row"))).where(F.col("place") <= max(max(x) for x in most)).drop("place")
    got = found.orderBy("list", "key", "row").toArrow()
    number, views, rows = got["list"].to_numpy(), _both(got), got["row"].to_numpy()
    out = {}
    for n, (t, v, label) in enumerate(lists):
        at = np.flatnonzero(number == n)[: most[t][label]]
        out[t, v, label] = rows[at], [x[at] for x in views]
    return out


def trained(docs: DataFrame, labels: DataFrame) -> Model:
    """The model for ``docs`` (doc_id, text, lang, source, n_chars), from labels (doc_id, quality) that match its rows."""
    known = labels.where("quality in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("i")).agg(F.max("quality").cast("double").alias("y"))
    with scope(docs.sparkSession):
        # texts stay where they are: only their views meet the labels
        rows = durable(views_of(docs).join(known, "i", "left").withColumn("row", F.monotonically_increasing_id()))
        ours = hash_sample(rows.where("y is not null"), "i", LABELLED, "row").orderBy("i", "row").toArrow()
        pool = rows.where("y is null")
        return fit(*_both(ours), ours["y"].to_numpy(), lambda weights, most: _surest(pool, weights, most))


def _scored(docs: DataFrame, model: Model, made, schema) -> DataFrame:
    """``made(rows, their scores)`` over ``docs``, whose columns come first in the rows."""
    names = [unused(docs.columns, n) for n in ("m_lang", "m_source", "m_chars")]
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            for part, data, offsets in tb.steps(batch, "text"):
                yield made(part, held.value.scores(describe(data, offsets), _record(*(part.column(part.schema.get_field_index(n)).to_numpy() for n in names))))

    return arrow(docs.select("*", *[c.alias(n) for n, c in zip(names, metadata_columns(docs))]), run, schema)


def score(docs: DataFrame, labels: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id of each row of ``docs``, content_score, metadata_score, score and keep."""
    docs = docs.select("doc_id", "text", "lang", "source", "n_chars")

    def made(part, scores):
        return pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, scores)], ["doc_id", "content_score", "metadata_score", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = _scored(docs, model or trained(docs, labels), made, f"doc_id {kind}, content_score double, metadata_score double, score double")
    return out.withColumn("keep", F.col("score") >= THRESHOLD)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that aren't rejected, with all their columns."""
    n = len(docs.columns)

    def made(part, scores):
        return part.select(part.schema.names[:n]).filter(pa.array(scores[2] >= THRESHOLD))

    return _scored(docs, trained(docs, labels), made, docs.schema)


def op7_quality_cotrain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
