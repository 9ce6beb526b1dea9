"""Language identification by a linear-chain conditional random field over words.

A document is a chain of words; each gets a label, a language. The score of a labelling is the sum of its words' scores
(features times learned weights) and of learned transitions between neighbours,

    log P(labels | words) = sum of E(word, label) + sum of T(label, next label) - log Z

so a short or ambiguous word takes the language of those around it, while a clear switch stays one. Marginals come from
the forward-backward recursion. Features of a word: prefixes and suffixes of 2 to 4 bytes (affixes), all runs of 2 to 4
bytes between its ends (n-grams), itself, and membership in each language's lexicon, the ``LEXICON`` most frequent words
of that language in the sample. All but the last are hashed into ``BUCKETS`` rows of weights.

Training: ``SAMPLE`` documents of each language at most, by hash of the id, of which up to ``PIECES`` spread runs of
``PIECE`` words are kept; training chains join runs of different documents, so transitions are learned from chains with
known switches (of language in about half of the joins). The likelihood is climbed by AdaGrad over
batches of chains, in a task of its own, whose size the sample bounds. Only text and language of training rows are read.

Labelling reads every word of every text: chains of at most ``CHAIN`` words side by side, so that a step of the recursion
is one small matrix product for all. A document's language is that of the largest share of its words' marginals, and the
score is that share; ``identify`` also returns shares and runs of words of a language, for code-switched texts.

Words are runs of ASCII letters and of bytes of other characters, lower-cased, cut every ``WORD_BYTES`` bytes (as in
scripts without blanks). Defined results: null texts and
texts without a letter are ``und`` with score 0; a null doc_id takes part as any other; repeated rows are labelled each;
without a training row every language is ``und`` with score 0; with one language that one is predicted; ties go to the
language that sorts first; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import textbytes as tb
from .common import arrow, durable, fold_of, scope, table

#: The bounds of the sample: documents of a language, and runs of words of a document and their length.
SAMPLE, PIECES, PIECE = 400, 4, 24
BUCKETS, LEXICON, CHAIN = 1 << 17, 1500, 128
EPOCHS, BATCH, RATE, RIDGE = 6, 64, 0.15, 1e-6
#: Bytes of distinct words whose features are held at once, and words whose scores a worker remembers.
FEATURE_BYTES, CACHE, WORD_BYTES = 1 << 19, 200_000, 64
UNKNOWN = "und"

_LETTER = np.zeros(256, dtype=bool)
_LETTER[97:123] = _LETTER[65:91] = _LETTER[128:] = True
_SALT = {(place, n): np.uint64(0x9E3779B97F4A7C15 * (4 * i + n) & 0xFFFFFFFFFFFFFFFF) for i, place in enumerate(("prefix", "suffix", "inner")) for n in (2, 3, 4)}


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end) of all words, and first[r] to first[r + 1] as the words of row r."""
    n = len(data)
    inside = np.zeros(n + 2, dtype=bool)
    inside[1:-1] = _LETTER[data]
    cut = np.zeros(n + 1, dtype=bool)
    cut[offsets] = True
    start = np.flatnonzero(inside[1:-1] & (~inside[:-2] | cut[:-1]))
    end = np.flatnonzero(inside[1:-1] & (~inside[2:] | cut[1:])) + 1
    parts = -(-(end - start) // WORD_BYTES)
    if len(parts) and parts.max() > 1:
        begin = np.repeat(start, parts) + WORD_BYTES * (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts))
        start, end = begin, np.minimum(begin + WORD_BYTES, np.repeat(end, parts))
    return start, end, np.searchsorted(start, offsets)


def loads_of(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, lower-cased."""
    padded = np.zeros(len(data) + 8, dtype=np.uint8)
    padded[: len(data)] = tb.LOWER[data]
    return np.ndarray(len(data) + 1, dtype="<u8", buffer=padded, strides=(1,))


def word_features(loads: np.ndarray, start: np.ndarray, end: np.ndarray, name: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, bucket, value) of the hashed features: affixes and the word count 1 each, n-grams 1 / sqrt(their number)."""
    size = end - start
    words, buckets, values = [np.arange(len(size))], [name % np.uint64(BUCKETS)], [np.ones(len(size))]

    def add(word: np.ndarray, at: np.ndarray, n: int, place: str, value: np.ndarray) -> None:
        gram = (loads[at] & np.uint64((1 << 8 * n) - 1)) + _SALT[place, n]
        words.append(word)
        buckets.append(tb.mix(gram) % np.uint64(BUCKETS))
        values.append(value)

    for n in (2, 3, 4):
        long = np.flatnonzero(size >= n)
        add(long, start[long], n, "prefix", np.ones(len(long)))
        add(long, end[long] - n, n, "suffix", np.ones(len(long)))
        inner = size[long] - n + 1
        word = np.repeat(long, inner)
        at = np.arange(len(word)) - np.repeat(np.cumsum(inner) - inner, inner) + start[word]
        add(word, at, n, "inner", (1 / np.sqrt(inner))[np.searchsorted(long, word)])
    return np.concatenate(words), np.concatenate(buckets).astype(np.int64), np.concatenate(values)


def forward_backward(emission: np.ndarray, transition: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals (chain, place, label), expected transitions (label, label) of all chains, and log Z of each chain; of
    emissions (chain, place, label), whose chains have some length, and are in order of falling length."""
    chains, places, labels = emission.shape
    top = emission.max(axis=2, keepdims=True)
    e, t = np.exp(emission - top), np.exp(transition)
    alpha, beta, scale = np.zeros_like(e), np.ones_like(e), np.ones((chains, places))
    live = [int(np.searchsorted(-length, -i)) for i in range(places)]  # chains that have a place i
    for i in range(places):
        n = live[i]
        a = e[:n, i] if i == 0 else (alpha[:n, i - 1] @ t) * e[:n, i]
        scale[:n, i] = a.sum(axis=1)
        alpha[:n, i] = a / scale[:n, i, None]
    pairs = np.zeros((labels, labels))
    for i in range(places - 2, -1, -1):
        n = live[i + 1]
        after = e[:n, i + 1] * beta[:n, i + 1] / scale[:n, i + 1, None]
        beta[:n, i] = after @ t.T
        pairs += alpha[:n, i].T @ after * t
    here = np.arange(places)[None] < length[:, None]
    marginal = alpha * beta * here[..., None]
    return marginal, pairs, ((np.log(scale) + top[..., 0]) * here).sum(axis=1)


class Model:
    """Languages with their weights; without a language, all texts are ``und``."""

    def __init__(self, languages: list[str], weights: np.ndarray, lexicon: np.ndarray, member: np.ndarray, lexical: np.ndarray, transition: np.ndarray):
        """``lexicon``: sorted names of words, ``member`` their languages (word, label), ``lexical`` the weights (language
        of the lexicon, label)."""
        self.languages, self.weights, self.lexicon, self.member, self.lexical, self.transition = languages, weights, lexicon, member, lexical, transition
        self._names, self._scores = np.zeros(0, np.uint64), np.zeros((0, len(languages)))

    def in_lexicons(self, name: np.ndarray) -> np.ndarray:
        """(word, language): 1 where a word is in the language's lexicon."""
        if not len(self.lexicon):
            return np.zeros((len(name), len(self.languages)))
        at = np.minimum(np.searchsorted(self.lexicon, name), len(self.lexicon) - 1)
        return self.member[at] * (self.lexicon[at] == name)[:, None]

    def emissions(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, name: np.ndarray) -> np.ndarray:
        """(word, label) of words, by pieces of bounded bytes; each name is worked out once as long as it is remembered."""
        distinct, where, back = np.unique(name, return_index=True, return_inverse=True)
        out = np.empty((len(distinct), len(self.languages)))
        at = np.minimum(np.searchsorted(self._names, distinct), max(0, len(self._names) - 1))
        known = self._names[at] == distinct if len(self._names) else np.zeros(len(distinct), dtype=bool)
        out[known] = self._scores[at[known]]
        new = np.flatnonzero(~known)
        loads = loads_of(data)
        cuts = np.unique(np.searchsorted(np.cumsum((end - start)[where[new]]), np.arange(0, len(data) + FEATURE_BYTES, FEATURE_BYTES), side="right"))
        for a, b in zip(np.append(0, cuts).tolist(), np.append(cuts, len(new)).tolist()):
            if a < b:
                some = where[new[a:b]]
                word, bucket, value = word_features(loads, start[some], end[some], distinct[new[a:b]])
                for label in range(len(self.languages)):
                    out[new[a:b], label] = np.bincount(word, weights=self.weights[bucket, label] * value, minlength=b - a)
                out[new[a:b]] += self.in_lexicons(distinct[new[a:b]]) @ self.lexical
        if len(new):
            names = np.concatenate([self._names, distinct[new]]) if len(self._names) + len(new) <= CACHE else distinct[new]
            scores = np.concatenate([self._scores, out[new]]) if len(self._names) + len(new) <= CACHE else out[new]
            order = np.argsort(names)[:CACHE]
            self._names, self._scores = names[order], scores[order]
        return out[back]

    def marginals(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(word, label) marginals of all words of some texts, the words' starts and ends, and the rows' first words."""
        start, end, first = words_of(data, offsets)
        if not len(start) or not self.languages:
            return np.zeros((len(start), len(self.languages))), start, end, first
        emission = self.emissions(data, start, end, tb.names(tb.LOWER[data], start, end)[0])
        row = np.repeat(np.arange(len(first) - 1), np.diff(first))
        place = (np.arange(len(start)) - first[row]) % CHAIN
        begin = np.flatnonzero(place == 0)
        length = np.diff(np.append(begin, len(start)))
        order = np.argsort(-length, kind="stable")
        at = np.empty(len(begin), dtype=np.int64)
        at[order] = np.arange(len(begin))
        chain = at[np.cumsum(place == 0) - 1]
        out = np.empty_like(emission)
        block = max(1, (1 << 18) // CHAIN)
        for a in range(0, len(begin), block):  # blocks of chains
            some = np.flatnonzero((chain >= a) & (chain < a + block)) if len(begin) > block else slice(None)
            n = length[order[a : a + block]]
            padded = np.zeros((len(n), int(n[0]), len(self.languages)))
            padded[chain[some] - a, place[some]] = emission[some]
            out[some] = forward_backward(padded, self.transition, n)[0][chain[some] - a, place[some]]
        return out, start, end, first

    def forget(self) -> None:
        self._names, self._scores = np.zeros(0, np.uint64), np.zeros((0, len(self.languages)))


def pieces(data: np.ndarray, offsets: np.ndarray) -> list[list[tuple[int, int, np.ndarray, np.ndarray]]]:
    """For each text up to PIECES runs of PIECE words, evenly spread: (first word, last word, starts, ends)."""
    start, end, first = words_of(data, offsets)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
        n = -(-(b - a) // PIECE)
        some = range(n) if n <= PIECES else sorted({i * (n - 1) // (PIECES - 1) for i in range(PIECES)})
        out.append([(a + i * PIECE, min(b, a + (i + 1) * PIECE), start, end) for i in some])
    return out


def fit(texts: list[bytes], langs: list[str], seed: int = 11) -> Model:
    """Train on texts of known language."""
    languages = sorted(set(langs))
    labels = len(languages)
    nothing = Model(languages, np.zeros((BUCKETS, labels)), np.zeros(0, np.uint64), np.zeros((0, labels)), np.zeros((labels, labels)), np.zeros((labels, labels)))
    data = np.frombuffer(b"".join(texts), dtype=np.uint8)
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts], dtype=np.int64))).astype(np.int64)
    start, end, first = words_of(data, offsets)
    if labels < 2 or not len(start):
        return nothing
    runs, label_of_run = [], []
    for r, found in enumerate(pieces(data, offsets)):
        runs += [(a, b) for a, b, *_ in found]
        label_of_run += [languages.index(langs[r])] * len(found)
    picked = np.concatenate([np.arange(a, b) for a, b in runs])
    y = np.repeat(label_of_run, [b - a for a, b in runs])
    name, back = np.unique(tb.names(tb.LOWER[data], start[picked], end[picked])[0], return_inverse=True)
    where = np.empty(len(name), dtype=np.int64)
    where[back] = picked
    # lexicons: the most frequent words of each language
    times = np.zeros((len(name), labels))
    np.add.at(times, (back, y), 1)
    member = np.zeros((len(name), labels))
    for label in range(labels):
        top = np.lexsort((name, -times[:, label]))[:LEXICON]
        member[top[times[top, label] > 1], label] = 1
    held = member.any(axis=1)
    word, bucket, value = word_features(loads_of(data), start[where], end[where], name)
    order = np.argsort(word, kind="stable")
    bucket, value = bucket[order], value[order]
    begin = np.searchsorted(word[order], np.arange(len(name) + 1))
    theta, lexical, transition = np.zeros((BUCKETS, labels)), np.zeros((labels, labels)), np.zeros((labels, labels))
    squares = [np.full(x.shape, 1e-8) for x in (theta, lexical, transition)]
    # chains of two to four runs, of which each comes from a shuffled document
    rng, cuts = np.random.default_rng(seed), np.cumsum([0] + [b - a for a, b in runs])
    for _ in range(EPOCHS):
        shuffled, chains = rng.permutation(len(runs)), []
        i = 0
        while i < len(shuffled):
            n = int(rng.integers(2, 5))
            own = shuffled[i : i + n]
            if rng.random() < 0.5:  # of one language, as most texts are
                own = own[np.asarray(label_of_run)[own] == label_of_run[own[0]]]
            chains.append(np.concatenate([np.arange(cuts[r], cuts[r + 1]) for r in own]))
            i += n
        for a in range(0, len(chains), BATCH):
            batch = sorted(chains[a : a + BATCH], key=len, reverse=True)
            length = np.array([len(c) for c in batch])
            flat = np.concatenate(batch)
            chain, place = np.repeat(np.arange(len(batch)), length), np.concatenate([np.arange(n) for n in length])
            used, of = np.unique(back[flat], return_inverse=True)
            size = begin[used + 1] - begin[used]
            feature = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(begin[used], size)
            who, rows, v = np.repeat(np.arange(len(used)), size), bucket[feature], value[feature]
            emission = np.stack([np.bincount(who, weights=theta[rows, k] * v, minlength=len(used)) for k in range(labels)], axis=1) + member[used] @ lexical
            padded = np.zeros((len(batch), int(length[0]), labels))
            padded[chain, place] = emission[of]
            marginal, expected, _ = forward_backward(padded, transition, length)
            slope = -marginal[chain, place]
            slope[np.arange(len(flat)), y[flat]] += 1
            by_word = np.stack([np.bincount(of, weights=slope[:, k], minlength=len(used)) for k in range(labels)], axis=1) / len(batch)
            touched, at = np.unique(rows, return_inverse=True)
            down = np.stack([np.bincount(at, weights=by_word[who, k] * v, minlength=len(touched)) for k in range(labels)], axis=1) - RIDGE * theta[touched]
            squares[0][touched] += down**2
            theta[touched] += RATE * down / np.sqrt(squares[0][touched])
            seen = np.zeros((labels, labels))
            inside = chain[1:] == chain[:-1]
            np.add.at(seen, (y[flat][:-1][inside], y[flat][1:][inside]), 1)
            for x, d, s in ((lexical, member[used].T @ by_word, squares[1]), (transition, (seen - expected) / len(batch), squares[2])):
                s += d**2
                x += RATE * d / np.sqrt(s)
    return Model(languages, theta.astype(np.float32), name[held], member[held], lexical, transition)


def training_rows(docs: DataFrame, held_out: Column, sample: int = SAMPLE) -> DataFrame:
    """(lang, place, text): at most ``sample`` rows of each language, by hash of id and length, that have letters."""
    known = docs.where(~held_out & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    hashed = known.select(F.col("lang").cast("string").alias("lang"), F.xxhash64(F.col("doc_id").cast("string"), F.length("text")).alias("h"), "text")
    # the hash of the last row of each language's sample; texts meet these few rows only
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    last = durable(hashed.select("lang", "h").withColumn("place", place).where(F.col("place") <= sample).groupBy("lang").agg(F.max("h").alias("last")))
    chosen = hashed.join(F.broadcast(last), "lang").where(F.col("h") <= F.col("last"))  # a row for each language
    again = F.row_number().over(Window.partitionBy("lang").orderBy("h", F.xxhash64("text")))
    return chosen.withColumn("place", again).where(F.col("place") <= sample).select("lang", "place", F.lower("text").alias("text"))


def trained(docs: DataFrame, held_out: Column, sample: int = SAMPLE) -> Model:
    """A model of the rows of ``docs`` (doc_id, text, lang) where ``held_out`` is false, fitted in one task."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((lang, place, text) for b in batches for lang, place, text in zip(*(b.column(i).to_pylist() for i in range(3))))
        # of a text only its pieces are kept
        langs, texts = [], []
        for lang, _, text in rows:
            raw = np.frombuffer(text.encode(), dtype=np.uint8)
            runs = pieces(raw, np.array([0, len(raw)]))[0]
            texts.append(b" ".join(raw[s[a] : e[b - 1]].tobytes() for a, b, s, e in runs) + b" ")
            langs.append(lang)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(texts, langs))], pa.binary())], ["model"])

    rows = durable(training_rows(docs, held_out, sample))
    return pickle.loads(arrow(rows.coalesce(1), made, "model binary").first()["model"])


def identify(docs: DataFrame, held_out: Column, sample: int = SAMPLE, runs: bool = True) -> DataFrame:
    """Of each row of ``docs`` (doc_id, text, lang): doc_id, held_out, lang_pred, score, n_words, and with ``runs`` also
    shares (of words by language) and runs (words [first, last) of one language, by their likeliest labels)."""
    with scope(docs.sparkSession):
        model = docs.sparkSession.sparkContext.broadcast(trained(docs, held_out, sample))
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, held_out boolean, lang_pred string, score double, n_words long" + ", shares map<string,double>, runs array<struct<first:int,last:int,lang:string>>" * runs
    names = [f.split()[0] for f in schema.split(", ")][: 5 + 2 * runs]

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        langs = np.array([*m.languages, UNKNOWN], dtype=object)
        for batch in batches:
            for part, data, offsets in tb.steps(batch, "text"):
                marginal, _, _, first = m.marginals(data, offsets)
                rows, n = part.num_rows, np.diff(first)
                row = np.repeat(np.arange(rows), n)
                share = np.stack([np.bincount(row, weights=marginal[:, k], minlength=rows) for k in range(len(m.languages))], axis=1) if m.languages else np.zeros((rows, 0))
                share /= np.maximum(1, n)[:, None]
                lettered = part.column(3).to_numpy(zero_copy_only=False).astype(bool) & (n > 0) & bool(m.languages)
                best = np.where(lettered, share.argmax(axis=1), len(m.languages)) if m.languages else np.zeros(rows, dtype=np.int64)
                score = np.where(lettered, np.clip(share.max(axis=1, initial=0), 0, 1), 0.0)
                columns = [part.column(0), part.column(2), pa.array(langs[best].tolist(), pa.string()), pa.array(score), pa.array(n)]
                if runs:
                    label = marginal.argmax(axis=1) if m.languages else np.zeros(0, np.int64)
                    row = row[: len(label)]
                    new = np.ones(len(label), dtype=bool)
                    new[1:] = (label[1:] != label[:-1]) | (row[1:] != row[:-1])
                    at = np.flatnonzero(new)
                    last = np.append(at[1:], len(label))
                    of = np.searchsorted(row[at], np.arange(rows + 1)).astype(np.int32)
                    inside = pa.StructArray.from_arrays([pa.array((at - first[row[at]]).astype(np.int32)), pa.array((last - first[row[at]]).astype(np.int32)), pa.array(langs[label[at]].tolist(), pa.string())], ["first", "last", "lang"])
                    some = np.flatnonzero((share > 0).ravel())
                    count = (share > 0).sum(axis=1)
                    keys = pa.array(langs[some % max(1, len(m.languages))].tolist(), pa.string())
                    columns += [pa.MapArray.from_arrays(pa.array(np.append(0, np.cumsum(count)).astype(np.int32)), keys, pa.array(share.ravel()[some])), pa.ListArray.from_arrays(pa.array(of), inside)]
                yield pa.RecordBatch.from_arrays(columns, names)
        m.forget()

    lowered = F.lower(F.coalesce("text", F.lit("")))
    return arrow(docs.select("doc_id", lowered.alias("text"), held_out.alias("held_out"), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)).alias("lettered")), made, schema)


def op11_language_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), fold_of() == 0, runs=False)
