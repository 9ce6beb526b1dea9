"""Toxicity by a subsequence string-kernel support vector machine with Nyström landmarks.

The kernel of two phrases sums, over all strings of three symbols, the products of their weights as subsequences: a
subsequence that spans s bytes weighs ``DECAY**s``, up to a span of ``SPAN``. Inserted characters and blanks only widen
the span, so ``wor-th*less`` stays near ``worthless``; letters spelled out with blanks between are joined to a token
first. The kernel is normalised, and its Nyström features are whitened similarities to landmark phrases.

A sentence is read through its phrases: its words, and its pairs of neighbouring words that don't tell on their own, so
that an insult of two harmless words is found. A document's values are those of its two strongest phrases.

Training: a bounded sample of labelled documents (``SAMPLE`` of each label at most, by hash of the id, as far as
``SAMPLE_CHARS`` reach). Witnesses are phrases chosen by support: each in turn is the one with the most toxic documents
that earlier ones leave unexplained, against the clean ones. They and what is near them in toxic documents are positive,
phrases of clean documents negative; landmarks are witnesses, the clean phrases nearest to them, and common words. A
linear machine with squared hinge loss is fitted to the features; its value collapses to one weight per string of three
symbols, so scoring a phrase is a sum of table lookups. The few phrases above ``GATE`` meet a second machine, with the same
landmarks and the kernel to the power ``POWER``, which tells an insult from words that only share most of its strings. Two
such pairs of machines, of either half of the documents, give values of the other half; a logistic curve over these, weighed to the labels' true shares, gives the score.

Scoring reads every byte of every text; a worker keeps the values of the tokens that it met lately. Defined results:
null, empty and wordless texts get the score of a text without any matching token; repeated rows are scored each; a
null doc_id takes part; without both labels in the sample every score is 0; an empty table gives an empty result;
extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textbytes as tb
from .common import arrow, fold_of, table

DECAY, SPAN, LANDMARKS, SAMPLE = 0.7, 8, 128, 1200
#: Least log-odds of a witness, its least unexplained documents as a share of the toxic ones (of words, which one document
#: has hundreds of, and of pairs), what a witness leaves of a document's weight, and how near (in the kernel) a phrase of a
#: toxic document must be to a witness to be positive.
TELLING, SUPPORT, PAIR_SUPPORT, LEFT, NEAR = 2.0, 0.005, 0.04, 0.3, 0.7
#: Most negative words in training: half of them the most frequent ones, half those nearest to witnesses.
NEGATIVES = 40_000
#: Value from which on a phrase meets the second machine, the power of the kernel there, and the weight there of a negative
#: phrase that is like no landmark, as a share of all negative ones.
GATE, POWER, PIN = -0.5, 4, 0.2
#: Characters of the labelled documents of either label in the sample, all together.
SAMPLE_CHARS = 12_000_000
CACHE = 200_000
#: Tokens whose features are held at once.
CHUNK = 2_000
#: Bytes from which on a token is read in windows.
LONG = 1 << 15
LOWEST = -4.0


def _symbols() -> np.ndarray:
    """Letters are 1-26, bytes of longer UTF-8 sequences 27-31, and all else is a gap. Digits and signs that stand for
    letters count as these letters."""
    out = np.zeros(256, dtype=np.int64)
    for i in range(26):
        out[97 + i] = out[65 + i] = 1 + i
    for sign, letter in zip("013457@$", "oieastas"):
        out[ord(sign)] = ord(letter) - 96
    out[128:] = 27 + np.arange(128) % 5
    return out


SYMBOL = _symbols()
STRINGS = 1 << 15


def triples(data: np.ndarray, start: np.ndarray, end: np.ndarray):
    """(token, string, weight, place of the first symbol among all) of the subsequences of three symbols of some tokens."""
    size = end - start
    token = np.repeat(np.arange(len(size)), size)
    at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(start, size)
    s = SYMBOL[data[at]]
    for wide in range(2, SPAN):
        if len(s) <= wide:
            break
        whole = (token[wide:] == token[:-wide]) & (s[wide:] > 0) & (s[:-wide] > 0)
        for mid in range(1, wide):
            some = np.flatnonzero(whole & (s[mid : len(s) - wide + mid] > 0))
            yield token[some], (s[some] << 10) | (s[some + mid] << 5) | s[some + wide], DECAY ** (wide + 1), some


def features(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sparse kernel features (token, string, value) of unit length per token."""
    found = list(triples(data, start, end))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    key = np.concatenate([t * STRINGS + c for t, c, *_ in found])
    weight = np.concatenate([np.full(len(t), w) for t, _, w, _ in found])
    order = np.argsort(key)
    key, weight = key[order], weight[order]
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(key)), bool), key[1:] != key[:-1])))
    if not len(first):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    key, value = key[first], np.add.reduceat(weight, first)
    token = key // STRINGS
    norm = np.sqrt(np.bincount(token, weights=value**2, minlength=len(start)))
    return token, key % STRINGS, value / norm[token]


def spelled_out(data: np.ndarray, w: tb.Words) -> list[tuple[int, bytes]]:
    """(row, joined bytes) of runs of three and more words of one byte."""
    single = (w.end - w.start == 1).astype(np.int8)
    row = np.repeat(np.arange(len(w.first) - 1), np.diff(w.first))
    if not single.any():
        return []
    step = np.flatnonzero(np.diff(np.concatenate(([0], single, [0]))))
    out = []
    for a, b in zip(step[::2].tolist(), step[1::2].tolist()):
        for r in np.unique(row[a:b]).tolist():
            inside = w.start[a:b][row[a:b] == r]
            if len(inside) >= 3:
                run = data[inside].tobytes()
                out += [(r, x) for x in (run, run[1:], run[:-1])]  # a one-letter word may precede or follow
    return out


def products(data: np.ndarray, start: np.ndarray, end: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Products of the kernel features of some phrases with a table (string, column)."""
    out = np.zeros((len(start), table.shape[1]), dtype=np.float32)
    for a in range(0, len(start), CHUNK):
        some, string, value = features(data, start[a : a + CHUNK], end[a : a + CHUNK])
        if len(some):
            first = np.flatnonzero(np.concatenate(([True], some[1:] != some[:-1])))
            out[a + some[first]] = np.add.reduceat(table[string] * value[:, None].astype(np.float32), first)
    return out


def neighbours(data: np.ndarray, w: tb.Words) -> np.ndarray:
    """Words that form a pair with the next one: of one row, one blank apart, and not the last of a sentence."""
    if len(w.start) < 2:
        return np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(w.first) - 1), np.diff(w.first))
    ends = np.isin(data[w.end[:-1] - 1], np.frombuffer(b".!?", np.uint8))
    return np.flatnonzero((row[1:] == row[:-1]) & (w.start[1:] == w.end[:-1] + 1) & (data[np.minimum(w.end[:-1], len(data) - 1)] == 32) & ~ends)


class Machine:
    """The fitted machine: a weight per string, an offset, the logistic curve, and whether pairs of words can tell."""

    def __init__(self, weight: np.ndarray, offset: float, curve: np.ndarray, pairs: bool = False, second: tuple | None = None):
        self.weight, self.offset, self.curve, self.pairs = weight, offset, curve, pairs
        #: landmarks (string, landmark), and the weights and offset of the second machine
        self.second = second
        self._seen: dict[int, float] = {}

    def clear(self) -> None:
        self._seen.clear()

    def values(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Of tokens."""
        out = np.empty(len(start))
        long = end - start > LONG
        for i in np.flatnonzero(long).tolist():
            out[i] = self._of_long(data, int(start[i]), int(end[i]))
        short = np.flatnonzero(~long)
        for a in range(0, len(short), 10 * CHUNK):
            some = short[a : a + 10 * CHUNK]
            token, string, value = features(data, start[some], end[some])
            first = np.bincount(token, weights=value * self.weight[string], minlength=len(some)) + self.offset
            near = np.flatnonzero(first > GATE)
            if self.second and len(near):
                first[near] = self._second(products(data, start[some[near]], end[some[near]], self.second[0]))
            out[some] = first
        return np.maximum(out, LOWEST)

    def _second(self, likeness: np.ndarray) -> np.ndarray:
        return likeness.astype(float) ** POWER @ self.second[1] + self.second[2]

    def _of_pairs(self, data: np.ndarray, w: tb.Words, value: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, value) of the pairs of words whose value is above 0; of words of the values ``value``. A value above 0 needs a
        sum of weights above 0, as the offset is below it, and only pairs with such a sum are normalised."""
        at = neighbours(data, w)
        at = at[(value[at] <= 0) & (value[at + 1] <= 0)]
        short = at[w.end[at + 1] - w.start[at] <= 5 * SPAN]
        raw = np.zeros(len(short))
        for a in range(0, len(short), 5 * CHUNK):
            some = short[a : a + 5 * CHUNK]
            for which, string, weight, _ in triples(data, w.start[some], w.end[some + 1]):
                raw[a : a + 5 * CHUNK] += np.bincount(which, weights=weight * self.weight[string], minlength=len(some))
        maybe = np.setdiff1d(at, short[raw <= 0]) if self.offset < 0 else at
        found = self.values(data, w.start[maybe], w.end[maybe + 1]) if len(maybe) else np.zeros(0)
        on = found > 0
        return row[maybe[on]], found[on]

    def _of_long(self, data: np.ndarray, start: int, end: int) -> float:
        """Of a long token, by windows that each hold the subsequences that begin in them."""
        total = np.zeros(STRINGS)
        for a in range(start, end, LONG):
            for _, string, weight, at in triples(data, np.array([a]), np.array([min(end, a + LONG + SPAN - 1)])):
                total += weight * np.bincount(string[at < LONG], minlength=STRINGS)
        norm = np.sqrt((total**2).sum())
        first = float(total @ self.weight / norm + self.offset) if norm else self.offset
        return float(self._second((total / norm) @ self.second[0])) if self.second and norm and first > GATE else first

    def _known(self, names: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        if len(self._seen) > CACHE:
            self._seen.clear()
        out = np.array([self._seen.get(x, np.nan) for x in names.tolist()], dtype=float)
        new = np.flatnonzero(np.isnan(out))
        if len(new):
            out[new] = self.values(data, start[new], end[new])
            self._seen.update(zip(names[new].tolist(), out[new].tolist()))
        return out

    def strongest(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """The two highest values of distinct tokens of each text."""
        w = tb.words(data, offsets)
        rows = len(offsets) - 1
        out = np.full((rows, 2), LOWEST)
        if not len(w.start):
            return out
        names, where, back = np.unique(w.name, return_index=True, return_inverse=True)
        value = self._known(names, data, w.start[where], w.end[where])
        row = np.repeat(np.arange(rows), np.diff(w.first))
        joined = spelled_out(data, w)
        if joined:
            flat = np.frombuffer(b"".join(x for _, x in joined), dtype=np.uint8)
            end = np.cumsum([len(x) for _, x in joined])
            more = self.values(flat, end - np.array([len(x) for _, x in joined]), end)
            row = np.concatenate([row, [r for r, _ in joined]])
            back = np.concatenate([back, len(value) + np.arange(len(more))])
            value = np.concatenate([value, more])
        if self.pairs:
            pair_row, more = self._of_pairs(data, w, value[back[: len(w.start)]], row[: len(w.start)])
            row = np.concatenate([row, pair_row])
            back = np.concatenate([back, len(value) + np.arange(len(more))])
            value = np.concatenate([value, more])
        some = value[back] > LOWEST
        row, back = row[some], back[some]
        np.maximum.at(out[:, 0], row, value[back])
        best = np.full(rows, -1)
        top = value[back] == out[row, 0]
        best[row[top]] = back[top]
        rest = back != best[row]
        np.maximum.at(out[:, 1], row[rest], value[back][rest])
        return out

    def scores(self, strongest: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(strongest @ self.curve[:2] + self.curve[2])))


def squared_hinge(z: np.ndarray, at: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-4) -> np.ndarray:
    """Weights (the last is the offset) of a linear machine for the rows ``at`` of z, by Newton steps on its active set."""
    dims = z.shape[1] + 1
    w, weight = np.zeros(dims), weight / weight.sum()
    penal = ridge * np.eye(dims)
    penal[-1, -1] = 1e-9
    for _ in range(30):
        gram, side = penal.copy(), np.zeros(dims)
        for a in range(0, len(at), 10 * CHUNK):
            some, own = slice(a, a + 10 * CHUNK), y[a : a + 10 * CHUNK]
            x = np.hstack([z[at[some]].astype(float), np.ones((len(own), 1))])
            on = own * (x @ w) < 1
            part = x[on] * weight[some][on, None]
            gram += part.T @ x[on]
            side += part.T @ own[on]
        new = np.linalg.solve(gram, side)
        if np.allclose(new, w, atol=1e-7):
            break
        w = new
    return w


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, ridge: float = 1e-2, steps: int = 40) -> np.ndarray:
    """Weights (the last is the offset) of a logistic regression, by Newton steps."""
    x = np.hstack([x, np.ones((len(x), 1))])
    weight = np.ones(len(x)) if weight is None else weight
    w = np.zeros(x.shape[1])
    penal = ridge * np.eye(len(w))
    penal[-1, -1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (p - y)) + penal @ w
        step = np.linalg.solve(penal + (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x, slope)
        w = w - np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return w


def _joined(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(raw), dtype=np.uint8), np.concatenate(([0], np.cumsum([len(x) for x in raw], dtype=np.int64))).astype(np.int64)


class Phrases:
    """Distinct words and pairs of words of some documents, words first: their spans, and which documents hold them."""

    def __init__(self, texts: list[str]):
        self.data, offsets = _joined([t.encode() for t in texts])
        w = tb.words(self.data, offsets)
        name, where, back = np.unique(w.name, return_index=True, return_inverse=True)
        doc = np.repeat(np.arange(len(texts)), np.diff(w.first))
        at = neighbours(self.data, w)
        pair, p_where, p_back = np.unique(tb.mix(w.name[at] * np.uint64(0x9E3779B97F4A7C15) + w.name[at + 1]), return_index=True, return_inverse=True)
        self.words = len(name)
        self.name = np.concatenate([name, pair])
        self.start = np.concatenate([w.start[where], w.start[at[p_where]]])
        self.end = np.concatenate([w.end[where], w.end[at[p_where] + 1]])
        #: the two words of each pair
        self.left, self.right = back[at[p_where]], back[at[p_where] + 1]
        key = np.unique(np.concatenate([doc * len(self.name) + back, doc[at] * len(self.name) + self.words + p_back]))
        self.doc, self.of = key // max(1, len(self.name)), key % max(1, len(self.name))

    def rows(self, which: np.ndarray, table: np.ndarray) -> np.ndarray:
        return products(self.data, self.start[which], self.end[which], table.astype(np.float32))

    def dense(self, i: int) -> np.ndarray:
        _, string, value = features(self.data, self.start[i : i + 1], self.end[i : i + 1])
        out = np.zeros(STRINGS)
        out[string] = value
        return out

    def witnesses(self, y: np.ndarray, used: np.ndarray, bad: np.ndarray, odds: np.ndarray, most: int) -> list[int]:
        telling = (bad >= 2) & (odds >= TELLING)
        telling[self.words :] &= ~(telling[self.left] | telling[self.right])
        inside = telling[self.of] & used[self.doc] & (y[self.doc] == 1)
        of, doc = self.of[inside], self.doc[inside]
        names, of = np.unique(of, return_inverse=True)
        weight, chosen, open_ = np.ones(len(y)), [], np.ones(len(names), dtype=bool)
        least = np.maximum(1, np.where(names < self.words, SUPPORT, PAIR_SUPPORT) * (used & (y == 1)).sum())
        while len(chosen) < most and open_.any():
            gain = np.bincount(of, weights=weight[doc], minlength=len(names))
            open_ &= gain >= least
            if not open_.any():
                break
            best = int(np.argmax(np.where(open_, gain * odds[names], 0)))
            chosen.append(int(names[best]))
            open_[best] = False
            weight[doc[of == best]] *= LEFT
        return chosen

    def machine(self, y: np.ndarray, used: np.ndarray, landmarks: int) -> Machine:
        """Of the documents ``used``, without a curve."""
        count = lambda label: np.bincount(self.of[used[self.doc] & (y[self.doc] == label)], minlength=len(self.name))
        bad, good = count(1), count(0)
        odds = np.log((bad + 0.05) / max(1, (used & (y == 1)).sum())) - np.log((good + 0.5) / max(1, (used & (y == 0)).sum()))
        chosen = self.witnesses(y, used, bad, odds, landmarks // 2)
        if not chosen:
            return Machine(np.zeros(STRINGS), LOWEST, np.zeros(3))
        pairs = any(i >= self.words for i in chosen)
        near = np.stack([self.dense(i) for i in chosen])
        # what stands near a witness in toxic documents, and nowhere else
        own = np.flatnonzero((bad[: self.words] > 0) & (good[: self.words] == 0))
        own = own[np.lexsort((self.name[own], -bad[own]))][:NEGATIVES]
        own = own[self.rows(own, near.T).max(axis=1) >= NEAR]
        positive = np.unique(np.concatenate([np.array(chosen), own]))
        clean = np.flatnonzero(good[: self.words] > 0)
        clean = clean[np.lexsort((self.name[clean], -good[clean]))]
        rare = clean[NEGATIVES // 2 :]
        hard = self.rows(rare, near.T).max(axis=1) if len(rare) else np.zeros(0)
        rare = rare[np.lexsort((self.name[rare], -hard))]
        clean = np.concatenate([clean[: NEGATIVES // 2], rare[: NEGATIVES // 2]])
        if pairs:
            told = np.isin(self.left, self.left[np.array([i - self.words for i in chosen if i >= self.words])]) | np.isin(self.right, self.right[np.array([i - self.words for i in chosen if i >= self.words])])
            others = self.words + np.flatnonzero(good[self.words :] > 0)
            others = others[np.lexsort((self.name[others], ~told[others - self.words]))][: NEGATIVES // 4]
            clean = np.concatenate([clean, others])
        clean = np.setdiff1d(clean, positive)
        closeness = self.rows(clean, near.T).max(axis=1) if len(clean) else np.zeros(0)
        marks: list[np.ndarray] = []
        for order, most in ((chosen, landmarks // 2), (clean[np.lexsort((self.name[clean], -closeness))], 3 * landmarks // 4), (clean[np.lexsort((self.name[clean], -good[clean]))], landmarks)):
            for i in list(order)[: 20 * landmarks]:
                if len(marks) >= most:
                    break
                x = self.dense(int(i))
                if x.any() and all(float(x @ c) < 0.9 for c in marks):
                    marks.append(x)
        if not marks:
            return Machine(np.zeros(STRINGS), LOWEST, np.zeros(3))
        marks = np.stack(marks)
        at, is_up = np.concatenate([positive, clean]), np.arange(len(positive) + len(clean)) < len(positive)
        likeness = self.rows(at, marks.T)
        times = np.where(is_up, np.log1p(bad[at]), np.log1p(good[at]))

        def fitted(power: int, some: np.ndarray) -> tuple[np.ndarray, float]:
            """Weights of the landmarks and the offset of a machine with the kernel to a power, of some phrases and of one, as a
            negative, that is like no landmark."""
            values, vectors = np.linalg.eigh((marks @ marks.T) ** power)
            white = vectors / np.sqrt(np.maximum(values, 1e-3))
            up, own = np.append(is_up[some], False), np.append(times[some], 1.0)
            own[-1] += PIN * own[:-1][~up[:-1]].sum()
            weight = np.where(up, own * (own[~up].sum() / own[up].sum()), own)
            z = np.vstack([likeness[some].astype(float) ** power @ white, np.zeros(white.shape[1])]).astype(np.float32)
            found = squared_hinge(z, np.arange(len(z)), np.where(up, 1.0, -1.0), weight)
            return white @ found[:-1], float(found[-1])

        weight, offset = fitted(1, np.arange(len(at)))
        second = fitted(POWER, np.flatnonzero(is_up | (likeness @ weight + offset > GATE)))
        return Machine(marks.T @ weight, offset, np.zeros(3), pairs, (np.ascontiguousarray(marks.T, dtype=np.float32), *second))


def strongest_of(machine: Machine, texts: list[str]) -> np.ndarray:
    raw = [t.encode() for t in texts]
    out = np.vstack([np.zeros((0, 2)), *[machine.strongest(*_joined(raw[i : i + 200])) for i in range(0, len(raw), 200)]])
    machine.clear()
    return out


def fit(texts: list[str], labels: list[int], landmarks: int = LANDMARKS, totals: tuple[int, int] | None = None) -> Machine:
    """Train on labelled texts, which stand for ``totals`` clean and toxic ones."""
    y = np.asarray(labels)
    if len(set(labels)) < 2:
        return Machine(np.zeros(STRINGS), LOWEST, np.array([0.0, 0.0, -50.0]))
    held = Phrases(texts)
    machine = held.machine(y, np.ones(len(y), dtype=bool), landmarks)
    half = np.zeros(len(y), dtype=bool)
    for label in (0, 1):
        half[np.flatnonzero(y == label)[::2]] = True
    unseen = np.zeros((len(y), 2))
    for part in (half, ~half):
        if min((y[part] == 0).sum(), (y[part] == 1).sum()) < 4:  # too few to learn from a half
            unseen = strongest_of(machine, texts)
            break
        others = np.flatnonzero(~part)
        unseen[others] = strongest_of(held.machine(y, part, landmarks), [texts[i] for i in others])
    shares = np.array([t / max(1, (y == label).sum()) for label, t in enumerate(totals or ((y == 0).sum(), (y == 1).sum()))])
    weight = shares[y] / shares[y].mean()
    machine.curve = logistic(unseen, y.astype(float), weight)
    return machine


def training_sample(docs: DataFrame, labels: DataFrame, held_out: Column, sample: int = SAMPLE, chars: int = SAMPLE_CHARS) -> tuple[list[str], list[int], tuple[int, int]]:
    """(texts, labels, all documents of either label): at most ``sample`` documents of each label, by hash of the id, of at most ``chars`` characters together, from those
    that aren't held out; of rows that repeat an id the least text."""
    known = labels.where("toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    # only ids meet the labels; the texts of the few chosen ones come by a broadcast of these
    ids = docs.where(~held_out).select("doc_id", F.coalesce(F.length("text"), F.lit(0)).alias("n")).groupBy("doc_id").agg(F.max("n").alias("n")).join(known, "doc_id")
    rows, of = [], {r["toxic"]: r["count"] for r in ids.groupBy("toxic").count().collect()}  # two rows
    for label in (0, 1):
        chosen, left = [], chars
        for r in ids.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).collect():
            if r["n"] <= left:
                chosen.append((r["doc_id"], label))
                left -= r["n"]
        if chosen:
            picked = docs.sparkSession.createDataFrame(chosen, ids.select("doc_id", "toxic").schema)
            met = docs.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
            rows += sorted(met.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic")).collect())
    return [r["text"] or "" for r in rows], [int(r["toxic"]) for r in rows], (of.get(0, 0), of.get(1, 0))


def trained(docs: DataFrame, labels: DataFrame, held_out: Column, sample: int = SAMPLE) -> Machine:
    texts, known, totals = training_sample(docs, labels, held_out, sample)
    return fit(texts, known, totals=totals)


def score(docs: DataFrame, labels: DataFrame, held_out: Column, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted of each row of ``docs`` (doc_id, text); labels are (doc_id, toxic)."""
    machine = docs.sparkSession.sparkContext.broadcast(trained(docs, labels, held_out, sample))

    def made(batches):
        for batch in batches:
            for part, data, offsets in tb.steps(batch, "text"):
                p = machine.value.scores(machine.value.strongest(data, offsets))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(p)], ["doc_id", "held_out", "score"])
        machine.value.clear()

    kind = docs.schema["doc_id"].dataType.simpleString()
    out = arrow(docs.select("doc_id", "text", held_out.alias("held_out")), made, f"doc_id {kind}, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), fold_of() == 0)
