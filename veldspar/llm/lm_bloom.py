"""Language-model scores from a log-frequency Bloom filter of quantised n-gram counts.

All training tokens and bigrams are counted, and their counts go into one filter whose size follows their number: an n-gram
of quantised count q is entered with the levels 1 to q (two an octave), and one of four and more occurrences also with its
eighth of the last level. Its count is read by probing levels until one is missing, then that level's eighths; if none is
there, the level was a false positive and the one before counts. That gives counts within about two in a hundred, and
exactly up to three. The model is a bigram that backs off to single tokens,

    P(w | v) = (min(c(v, w), c(v), c(w)) + MU * P(w)) / (c(v) + MU + F)
    P(w)     = (c(w) + 0.5) / (sum of c + 0.5 * (types + 1))

where each c is read from the filter (of the ``WARM`` most frequent tokens it is known, and quantised as there), and F (0 for a v that isn't known) is what unknown bigrams of v are expected to add
by false positives. A level-1 entry is checked in ``CHECKS`` words, at any size of the input, so an unknown n-gram seems
known in one of five billion cases and F is under a hundredth for 40 million types. The probabilities of all types and of
an unknown one sum to one after any v, but for a few in a hundred.

The filter has ``SHARDS`` shards, by a remainder of the n-gram's name, each sized by its own entries. Texts go in buckets of
a few megabytes, by a hash of the row. A bucket sends its distinct n-grams with their training counts, as compressed steps from one name to the next, to
the parts of the filter (some shards each); a part sums the counts, enters them, reads what each bucket asked for, and sends the levels back
to the buckets' texts. So the n-grams move once, no filter is stored, broadcast or seen by the driver, and a task holds one
part or one bucket at a time. Neither the number of parts nor of buckets changes a level.

Base scores need exact counts: the ``WARM`` most frequent tokens go to the workers with their counts, a table of fixed
size; all other tokens of a document meet their counts in a shuffle join on the token, which 128-bit names stand for.

Defined results: null text is empty; an empty document is one end token; repeated rows are scored each; a null doc_id
takes part as any other; with no training rows every probability of the base is 1; an empty table gives an empty
result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textbytes as tb
from .common import arrow, durable, fold_of, scope, table

WARM, MU, STEPS_PER_OCTAVE, EIGHTHS = 1 << 18, 16.0, 2, 8
#: Shards of the filter; its bits for each entry and word, and how many of a word an entry sets; bits of a part, about.
SHARDS, ENTRY_BITS, HASHES, FILTER_BITS = 4096, 12, 5, 1 << 27
#: Words in which a level-1 entry is checked, and the rate of false positives of one.
CHECKS, WORD_RATE = 5, 0.0115
#: Bytes of text of a bucket, about, and of a token.
BUCKET_BYTES, TOKEN_BYTES = 1 << 21, 6
#: Names of the end token and of what stands before a row, and base of the names of bigrams.
END, END_OTHER, START = np.uint64(0xE5D0C0DE0000E5D1), np.uint64(0x0E5D0C0DE0E5D2E5), np.uint64(0x57A27C0DE00057A2)
_BI = np.uint64(0x3C79AC492BA7B653)
#: Distinct entries that a worker combines before it sends them on.
COMBINE = 1_000_000

TOKENS = "token long, other long, n long"
SCORED = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, token long, other long, tf long"
ASKED, ANSWERED = "bucket int, part int, size int, names binary, n binary", "bucket int, part int, size int, levels binary"


def code(n: np.ndarray) -> np.ndarray:
    """Quantised logarithm of counts, level * EIGHTHS + eighth: level 0 for 0, else 1 and more."""
    y = STEPS_PER_OCTAVE * np.log2(np.maximum(n, 1)) + 1e-9
    q = np.floor(y)
    return np.where(n > 0, (q + 1) * EIGHTHS + np.where(n > 3, np.floor(EIGHTHS * (y - q)), 0), 0).astype(np.int64)


def value(c: np.ndarray) -> np.ndarray:
    """The count that a code stands for: exact up to 3, else the middle of those with the code."""
    q, eighth = c // EIGHTHS, c % EIGHTHS
    return np.where(q > 4, np.exp2((q - 1 + (eighth + 0.5) / EIGHTHS) / STEPS_PER_OCTAVE), np.array([0, 1, 1, 2, 3])[np.minimum(q, 4)])


def value_column(n: Column) -> Column:
    """value(code(n)) of a positive count."""
    y = F.lit(STEPS_PER_OCTAVE) * F.log2(n.cast("double")) + 1e-9
    eighth = (F.floor(F.lit(EIGHTHS) * (y - F.floor(y))) + 0.5) / EIGHTHS
    return F.when(n > 3, F.pow(F.lit(2.0), (F.floor(y) + eighth) / STEPS_PER_OCTAVE)).otherwise(n.cast("double"))


def checks_for(types: int) -> int:
    """Words in which a level-1 entry is checked: the same for any number of types."""
    return CHECKS


def shard_of(name: np.ndarray, shards: int) -> np.ndarray:
    """As Spark's pmod of the name as a signed number."""
    return name.view(np.int64) % shards


class LogFrequencyFilter:
    """A Bloom filter of n-grams with their levels and eighths. An entry sets HASHES bits of one 64-bit word of its shard;
    level 1, which tells known n-grams from unknown ones, has ``checks`` entries."""

    def __init__(self, sizes: np.ndarray, words: np.ndarray | None = None, checks: int = 1):
        """``sizes``: the words of each shard, one at least."""
        self.sizes, self.shards, self.checks = sizes.astype(np.uint64), len(sizes), checks
        self.first = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
        self.words = np.zeros(self.first[-1], dtype=np.uint64) if words is None else words

    def _place(self, name: np.ndarray, shard: np.ndarray, j: int | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Entry j: 16 times a level, its eighths from 1 on after it; -1, -2 and so on are further checks of level 1."""
        x = tb.mix(name + np.asarray(j, dtype=np.int64).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        at = self.first[shard] + (((x >> np.uint64(32)) * self.sizes[shard]) >> np.uint64(32)).astype(np.int64)
        mask = np.zeros(len(name), dtype=np.uint64)
        for i in range(HASHES):  # from the half that doesn't choose the word
            mask |= np.uint64(1) << ((x >> np.uint64(6 * i)) & np.uint64(63))
        return at, mask

    def _holds(self, name: np.ndarray, shard: np.ndarray, j: int | np.ndarray) -> np.ndarray:
        at, mask = self._place(name, shard, j)
        return self.words[at] & mask == mask

    def add(self, name: np.ndarray, codes: np.ndarray) -> None:
        shard, q = shard_of(name, self.shards), codes // EIGHTHS
        enter = lambda some, j: np.bitwise_or.at(self.words, *self._place(name[some], shard[some], j))
        for j in range(1, int(q.max(initial=0)) + 1):
            enter(np.flatnonzero(q >= j), 16 * j)
        for j in range(1, self.checks):
            enter(np.flatnonzero(q > 0), -j)
        fine = np.flatnonzero(q > 4)
        enter(fine, 16 * q[fine] + 1 + codes[fine] % EIGHTHS)

    def read(self, name: np.ndarray) -> np.ndarray:
        """Codes, by repeated probes: levels never too low, and seldom too high."""
        shard = shard_of(name, self.shards)
        q, live, j = np.zeros(len(name), dtype=np.int64), np.arange(len(name)), 1
        while len(live):
            live = live[self._holds(name[live], shard[live], 16 * j)]
            for check in range(1, self.checks if j == 1 else 1):
                live = live[self._holds(name[live], shard[live], -check)]
            q[live] = j
            j += 1
        out, live = q * EIGHTHS, np.flatnonzero(q > 4)
        while len(live):
            some = live
            for eighth in range(EIGHTHS):
                there = self._holds(name[some], shard[some], 16 * q[some] + 1 + eighth)
                out[some[there]] = q[some[there]] * EIGHTHS + eighth
                some = some[~there]
            q[some] -= 1
            out[some] = q[some] * EIGHTHS
            live = some[q[some] > 4]
        return out

    def rate(self) -> float:
        """How often an entry that wasn't made seems to be there."""
        return float(((np.bitwise_count(self.words) / 64.0) ** HASHES).mean())


def _entries(codes: np.ndarray, checks: int) -> np.ndarray:
    q = codes // EIGHTHS
    return q + (checks - 1) * (q > 0) + (q > 4)


def entries_of(codes: np.ndarray, checks: int) -> int:
    """How many entries n-grams of some codes make."""
    return int(_entries(codes, checks).sum())


def words_for(entries: np.ndarray, entry_bits: int = ENTRY_BITS) -> np.ndarray:
    """64-bit words for so many entries."""
    return np.maximum(1, -(-entries * entry_bits // 64))


def filter_of(name: np.ndarray, n: np.ndarray, shards: int = SHARDS, entry_bits: int = ENTRY_BITS, checks: int = CHECKS) -> LogFrequencyFilter:
    """The filter of n-grams with their counts; shards that have none of them take a word each."""
    codes = code(n)
    entries = np.bincount(shard_of(name, shards), weights=_entries(codes, checks), minlength=shards).astype(np.int64)
    out = LogFrequencyFilter(words_for(entries, entry_bits), checks=checks)
    out.add(name, codes)
    return out


class Combiner:
    """Sums counts by name, or by both names, within a worker; hands on what it has beyond COMBINE distinct keys."""

    def __init__(self, columns: list[str]):
        self.columns, self.parts, self.size = columns, [], 0

    def add(self, *part: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Names, perhaps second names, and counts."""
        self.parts.append(part)
        self.size += len(part[0])
        if self.size > COMBINE:
            merged = self._merged()
            full = len(merged[0]) > COMBINE // 2
            if full:
                yield self._batch(merged)
            self.parts, self.size = ([], 0) if full else ([merged], len(merged[0]))

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.parts:
            yield self._batch(self._merged())

    def _merged(self) -> tuple[np.ndarray, ...]:
        *keys, n = [np.concatenate(x) for x in zip(*self.parts)]
        first, back = tb.distinct(*keys)
        return *[k[first] for k in keys], np.bincount(back, weights=n, minlength=len(first)).astype(np.int64)

    def _batch(self, merged: tuple[np.ndarray, ...]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in merged], self.columns)


def tokens_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Both names of all tokens, the end token after each row's words, and the offsets of rows in them."""
    w = tb.words(data, offsets, 2)
    first = w.first + np.arange(len(w.first))
    ends = first[1:] - 1
    word = np.ones(first[-1], dtype=bool)
    word[ends] = False
    out = np.empty((2, first[-1]), dtype=np.uint64)
    out[0, word], out[1, word] = w.name, w.other
    out[0, ends], out[1, ends] = END, END_OTHER
    return out[0], out[1], first


def bigrams_of(names: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A name for each token with the one before it."""
    before = np.empty_like(names)
    before[1:] = names[:-1]
    before[first[:-1]] = START
    return tb.mix(tb.mix(before + _BI) + names)


def count_tokens(training: DataFrame) -> DataFrame:
    """(token, other, n)."""

    def made(batches):
        combined = Combiner(["token", "other", "n"])
        for batch in batches:
            for _, data, offsets in tb.steps(batch, "text"):
                names, others, _ = tokens_of(data, offsets)
                first, back = tb.distinct(names, others)
                yield from combined.add(names[first], others[first], np.bincount(back, minlength=len(first)))
        yield from combined.rest()

    return arrow(training.select("text"), made, TOKENS).groupBy("token", "other").agg(F.sum("n").alias("n"))


class Warm:
    """The most frequent tokens with their counts."""

    def __init__(self, token: np.ndarray, other: np.ndarray, n: np.ndarray):
        order = np.argsort(token, kind="stable")
        self.token, self.other, self.n = token[order], other[order], n[order]

    def find(self, name: np.ndarray, other: np.ndarray) -> np.ndarray:
        """Counts; -1 for tokens that aren't here."""
        if not len(self.token):
            return np.full(len(name), -1)
        at = np.minimum(np.searchsorted(self.token, name), len(self.token) - 1)
        return np.where((self.token[at] == name) & (self.other[at] == other), self.n[at], -1)


def probability(both: np.ndarray, before: np.ndarray, after: np.ndarray, norm: float, false: float) -> np.ndarray:
    """P(w | v) of c(v, w), c(v) and c(w)."""
    seen = np.minimum(np.minimum(both, before), after)
    return (seen + MU * (after + 0.5) / norm) / (before + MU + np.where(before > 0, false, 0.0))


class Step:
    """The tokens and n-grams of some rows, and what the model says of them once levels are known."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, warm: Warm):
        names, others, self.first = tokens_of(data, offsets)
        at, self.token = tb.distinct(names, others)
        self.name, self.other = names[at], others[at]
        grams = bigrams_of(names, self.first)
        at, self.pair = tb.distinct(grams)
        before = np.empty_like(self.token)
        before[1:] = self.token[:-1]
        before[self.first[:-1]] = -1
        self.second, self.lead = self.token[at], before[at]
        self.n = warm.find(self.name, self.other)
        self.cold = np.flatnonzero(self.n < 0)
        #: what is asked of the filter: distinct tokens that aren't warm, then distinct bigrams
        self.grams = np.concatenate([self.name[self.cold], grams[at]])

    def times(self, rows: np.ndarray) -> np.ndarray:
        """How often the rows that are marked have each of ``grams``."""
        some = np.repeat(rows, np.diff(self.first))
        return np.concatenate([np.bincount(self.token[some], minlength=len(self.name))[self.cold], np.bincount(self.pair[some], minlength=len(self.second))])

    def parts(self, shards: int, parts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """An order of ``grams`` by their parts of the filter, the parts met, and where in the order each of them begins."""
        part = shard_of(self.grams, shards) % parts
        order = np.argsort(part, kind="stable")
        return order, *np.unique(part[order], return_index=True)

    def scores(self, codes: np.ndarray, at_start: float, norm: float, false: float) -> np.ndarray:
        """Log10 probability of each row, from the codes of ``grams``."""
        known = code(np.maximum(self.n, 0))
        known[self.cold] = codes[: len(self.cold)]
        own, both = value(known), value(codes[len(self.cold) :])
        begun = np.where(self.lead < 0, at_start, own[self.lead]) if len(own) else both
        after = own[self.second] if len(own) else both
        log_p = np.log10(probability(both, begun, after, norm, false))
        rows = len(self.first) - 1
        return np.bincount(np.repeat(np.arange(rows), np.diff(self.first)), weights=log_p[self.pair], minlength=rows)

    def base(self, log_norm: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Known tokens and base score of each row as far as warm tokens go; (row, token, times) of the others."""
        rows = len(self.first) - 1
        of = np.repeat(np.arange(rows), np.diff(self.first))
        n, is_warm = self.n, self.n >= 0
        part = np.where(is_warm, np.log10(np.maximum(n, 0) + 0.5) - log_norm, 0.0)
        known = np.bincount(of, weights=is_warm[self.token], minlength=rows).astype(np.int64)
        cold = np.flatnonzero(~is_warm[self.token])
        keys, times = np.unique(of[cold] * max(1, len(n)) + self.token[cold], return_counts=True)
        return known, np.bincount(of, weights=part[self.token], minlength=rows), keys // max(1, len(n)), keys % max(1, len(n)), times


def _rows(step: Step, row: int, part: pa.RecordBatch, score: np.ndarray, log_norm: float) -> pa.RecordBatch:
    """A row for each text, and one for each of its distinct tokens that aren't warm."""
    known, base, to, which, tf = step.base(log_norm)
    rows, n_met, none = len(known), len(to), pa.nulls
    ids = row + np.arange(rows)
    spread = tb.mix(ids.astype(np.uint64))  # what needs no join goes anywhere
    both = lambda x, kind: pa.concat_arrays([x if isinstance(x, pa.Array) else pa.array(x), none(n_met, kind)])
    columns = [
        pa.array(np.concatenate([ids, row + to])), both(part.column(0).cast(pa.int64()), pa.int64()), both(part.column(2), pa.bool_()), both(np.diff(step.first), pa.int64()), both(known, pa.int64()),
        both(base, pa.float64()), both(score, pa.float64()), pa.array(np.concatenate([spread, step.name[which]]).view(np.int64)), pa.array(np.concatenate([spread, step.other[which]]).view(np.int64)),
        pa.concat_arrays([none(rows, pa.int64()), pa.array(tf)]),
    ]
    return pa.RecordBatch.from_arrays(columns, SCORED_NAMES)


SCORED_NAMES = [x.split()[0] for x in SCORED.split(", ")]


def packed(v: np.ndarray) -> bytes:
    """Numbers as compressed planes of bytes."""
    return pa.compress(np.ascontiguousarray(v.view(np.uint8).reshape(len(v), -1).T), codec="zstd", asbytes=True)


def unpacked(raw: bytes, size: int, kind: type) -> np.ndarray:
    wide = np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(raw, size * wide, codec="zstd"), dtype=np.uint8)
    return planes.reshape(wide, size).T.copy().view(kind).ravel()


def _met(table: pa.Table, warm: Warm) -> tuple[pa.RecordBatch, Step]:
    """A bucket's rows (bucket, doc_id, text, held_out), and their tokens and n-grams."""
    part = table.select(["doc_id", "text", "held_out"]).combine_chunks().to_batches()[0]
    return part, Step(*tb.buffer_of(part.column(1)), warm)


def asked_of(texts: DataFrame, shards: int, parts: int, model) -> DataFrame:
    """(bucket, part, size, names, n): the distinct n-grams of each bucket by their parts of the filter, as steps from one
    name to the next, and how often its training rows have them."""

    def made(table: pa.Table) -> pa.Table:
        part, step = _met(table, model.value[0])
        n = step.times(~part.column(2).to_numpy(zero_copy_only=False)).astype(np.uint32)
        order, met, begin = step.parts(shards, parts)
        names, n = (np.split(v[order], begin[1:]) for v in (step.grams, n))
        columns = [[table["bucket"][0].as_py()] * len(met), met, [len(x) for x in n], [packed(np.diff(x, prepend=np.uint64(0))) for x in names], [packed(x) for x in n]]
        return pa.table([pa.array(x, t) for x, t in zip(columns, [pa.int32()] * 3 + [pa.binary()] * 2)], ["bucket", "part", "size", "names", "n"])

    return texts.groupBy("bucket").applyInArrow(made, ASKED)


def answers(asked: DataFrame, shards: int, entry_bits: int, checks: int) -> DataFrame:
    """(bucket, part, size, levels): each part of the filter is made of all counts that are sent to it, and read for all names."""

    def made(table: pa.Table) -> pa.Table:
        sizes = table["size"].to_pylist()
        names = np.concatenate([np.cumsum(unpacked(v.as_buffer(), k, np.uint64), dtype=np.uint64) for v, k in zip(table["names"], sizes)])
        n = np.concatenate([unpacked(v.as_buffer(), k, np.uint32) for v, k in zip(table["n"], sizes)])
        first, back = tb.distinct(names)
        name, total = names[first], np.bincount(back, weights=n).astype(np.int64)
        known = total > 0
        levels = filter_of(name[known], total[known], shards, entry_bits, checks).read(name).astype(np.uint16)[back]
        told = pa.array([packed(x) for x in np.split(levels, np.cumsum(sizes)[:-1])], pa.binary())
        return pa.table([table["bucket"], table["part"], table["size"], told], ["bucket", "part", "size", "levels"])

    return asked.groupBy("part").applyInArrow(made, ANSWERED)


def _scored(texts: DataFrame, told: DataFrame, shards: int, parts: int, model) -> DataFrame:
    def made(table: pa.Table, levels: pa.Table) -> pa.Table:
        warm, log_norm, *rest = model.value
        part, step = _met(table, warm)
        codes = np.empty(len(step.grams), dtype=np.int64)
        by = levels.sort_by("part")
        codes[step.parts(shards, parts)[0]] = np.concatenate([unpacked(v.as_buffer(), k, np.uint16) for v, k in zip(by["levels"], by["size"].to_pylist())])
        return pa.Table.from_batches([_rows(step, table["bucket"][0].as_py() << 32, part, step.scores(codes, *rest), log_norm)])

    return texts.groupBy("bucket").cogroup(told.groupBy("bucket")).applyInArrow(made, SCORED)


def most_frequent(counts: DataFrame, most: int) -> Warm:
    """All tokens from some count on, of which there are at most ``most``."""
    octaves = counts.groupBy(F.floor(F.log2(F.col("n").cast("double")) * 16).alias("q")).agg(F.count("*").alias("tokens"), F.min("n").alias("least"))
    least, left = None, most
    for r in sorted(octaves.collect(), key=lambda r: -r["q"]):  # some hundred rows
        if r["tokens"] > left:
            break
        least, left = r["least"], left - r["tokens"]
    top = counts.where(F.col("n") >= least if least else F.lit(False)).toArrow()
    return Warm(*(top[c].to_numpy().view(np.uint64) for c in ("token", "other")), top["n"].to_numpy())


def score(docs: DataFrame, held_out: Column, shards: int = SHARDS, filter_bits: int = FILTER_BITS, most_warm: int = WARM, entry_bits: int = ENTRY_BITS) -> DataFrame:
    """Scores of the rows of ``docs`` (doc_id, text); the model learns from those where ``held_out`` is false."""
    with scope(docs.sparkSession):
        return durable(_score(docs.select("doc_id", "text", held_out.alias("held_out")), shards, filter_bits, most_warm, entry_bits), keep=True)


def _score(docs: DataFrame, shards: int, filter_bits: int, most_warm: int, entry_bits: int) -> DataFrame:
    training = docs.where("not held_out")
    counts = durable(count_tokens(training))
    ends = (F.col("token") == int(END.view(np.int64))) & (F.col("other") == int(END_OTHER.view(np.int64)))
    total, types, soft, starts = counts.agg(
        F.coalesce(F.sum("n"), F.lit(0)), F.count("*"), F.coalesce(F.sum(value_column(F.col("n"))), F.lit(0.0)), F.coalesce(F.max(F.when(ends, F.col("n"))), F.lit(0))
    ).first()
    warm, checks = most_frequent(counts, most_warm), checks_for(types)
    norm, log_norm = float(soft + 0.5 * (types + 1)), float(np.log10(total + 0.5 * (types + 1)))
    model = docs.sparkSession.sparkContext.broadcast((warm, log_norm, float(starts), norm, WORD_RATE**checks * types))
    # a row has its end token, and about so many entries a token
    size = docs.agg(F.coalesce(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + TOKEN_BYTES), F.lit(0))).first()[0]
    buckets, parts = -(-size // BUCKET_BYTES) or 1, max(1, min(shards, -(-size * checks * entry_bits // (TOKEN_BYTES * max(1, filter_bits)))))
    texts = docs.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(buckets)).cast("int").alias("bucket"), "doc_id", "text", "held_out")
    rows = _scored(texts, answers(asked_of(texts, shards, parts, model), shards, entry_bits, checks), shards, parts, model)
    met = rows.join(counts.withColumnRenamed("n", "c"), ["token", "other"], "left")
    c, is_cold = F.coalesce("c", F.lit(0)), F.col("tf").isNotNull()
    return (
        met.groupBy("row")
        .agg(
            F.max("doc_id").alias("doc_id"),
            F.max("held_out").alias("held_out"),
            F.max("n_tokens").alias("n_tokens"),
            F.sum(F.when(is_cold, F.when(c > 0, F.col("tf")).otherwise(0)).otherwise(F.col("n_known"))).alias("n_known"),
            F.sum(F.when(is_cold, F.col("tf") * (F.log10(c + 0.5) - log_norm)).otherwise(F.col("base"))).alias("base_score"),
            F.max("score").alias("score"),
        )
        .select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score", (F.col("score") / F.col("n_tokens")).alias("score_per_token"))
    )


def op4_lm_bloom(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), fold_of() == 1)
