"""Packing, sampling, language model, toxicity, quality and personal data against brute force and round trips."""

import collections
import itertools
import math
import os
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from veldspar.llm import lm_bloom, packing, pii_infotheory, quality_cotrain, sp_sampling, toxicity
from veldspar.llm import textbytes as tb
from veldspar.llm.common import fold_of

DOCS = "doc_id long, text string, lang string, source string, n_chars long, row string, token string"
ODD = [(900, None), (901, ""), (902, " \n"), (903, "<|endoftext|> don't we'll 'twas I'm  x y　　z\n\n\nq'"), (904, "日本語のテキスト 12,345.67 ½²Ⅷ  "), (905, "\U0001f389" * 40), (906, "nospace" * 3000), (907, "\r\n \t " * 50), (None, "no id"), (908, "'s 's's !'s 'S 're're"), (908, "'s 's's !'s 'S 're're")]


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", "y") for i, t in rows], DOCS)


def prose(seed, n, words=60):
    rng = np.random.default_rng(seed)
    stock = ["".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(2, 9))) for _ in range(300)]
    return [(i, " ".join(stock[min(299, int(rng.zipf(1.3)))] for _ in range(rng.integers(1, words))) + ".") for i in range(n)]


def test_tokens_equal_those_of_the_library_and_packing_is_whole(spark):
    tokenizers = pytest.importorskip("tokenizers")
    tok = tokenizers.Tokenizer.from_file(packing.vocabulary_path("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    rows = prose(1, 80, 900) + ODD
    out = packing.pack(docs_of(spark, rows).repartition(2), packing.vocabulary_path("byte_bpe_50k.tiktoken")).collect()
    pieces = collections.defaultdict(list)
    for r in out:
        pieces[r["doc_id"]].append((r["start"], np.frombuffer(r["ids"], "<u4").tolist(), r["doc_tokens"]))
    for i, t in rows:
        ids = tok.encode(t or "", add_special_tokens=False).ids + [1]
        times = sum(j == i for j, _ in rows)  # a repeated row may be cut elsewhere
        assert all(ids[a : a + len(p)] == p and n == len(ids) for a, p, n in pieces[i])
        assert collections.Counter(a + j for a, p, _ in pieces[i] for j in range(len(p))) == collections.Counter({j: times for j in range(len(ids))})
    bins = collections.defaultdict(list)
    for r in out:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    padding = 0
    for found in bins.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert 0 < at <= 2048
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    assert padding <= 0.02 * sum(r["length"] for r in out)


def test_bins_take_a_fixed_count_and_cuts_add_up():
    for n in (1, 63, 64, 65, 2047, 2048, 2049, 5000):
        assert sum(packing.cuts(n)) == n
    bins, rows = packing.Bins(2048, 0), []
    for i in range(40):
        rows += bins.add((i, 0, np.zeros(50, np.uint32), 50))
    assert len(rows) == 40 and {r[4] for r in rows} == {0}
    rows = list(bins.add((99, 0, np.arange(50, dtype=np.uint32), 50))) + list(bins.close())
    assert [r[2] for r in rows] == [32, 16, 2]
    assert packing.pack is not None


def test_packing_of_nothing(spark):
    assert packing.packed_digests(docs_of(spark, [(1, "a")]).limit(0)).count() == 0


def test_every_sample_decodes_and_differs(spark):
    path = packing.vocabulary_path("piece_bpe_32k.model")
    rows = prose(2, 12) + [(i, t) for i, t in ODD if i not in (906, 908)] + [(910, "▁ ▁x"), (911, "the the"), (911, "the the")]
    df = docs_of(spark, rows)
    enc = sp_sampling.encode(df, path, 3)
    text = collections.defaultdict(set)
    for r in sp_sampling.decode(enc, path).collect():
        text[r["doc_id"]].add(r["text"])
    assert text == {i: {t or ""} for i, t in rows}
    by = collections.defaultdict(list)
    for r in enc.collect():
        by[r["doc_id"], r["sample"]].append(r["ids"])
        assert 0 < r["inclusion"] <= 1 and r["log_prob"] <= 1e-9
    assert len(set(by[911, 0])) == 1
    assert all(by[i, 0][0] != by[i, 1][0] for i, _ in prose(2, 12))
    again = {(r["doc_id"], r["sample"]): r["ids"] for r in sp_sampling.encode(df.repartition(3), path, 3).collect()}
    assert all(by[k][0] == v for k, v in again.items())
    assert sp_sampling.encode(df.limit(0), path).count() == 0


def test_samples_follow_the_exact_distribution():
    vocabulary = sp_sampling.lattices_of(packing.vocabulary_path("piece_bpe_32k.model")).vocabulary
    text, n = "thin air", 3000
    raw = text.encode() * n
    offsets = np.arange(n + 1) * len(text)
    lattices = sp_sampling.Lattices(vocabulary)
    paths_, last = sp_sampling.samples(lattices, np.frombuffer(raw, np.uint8), offsets, np.arange(n, dtype=np.uint64), 2)
    found = [[] for _ in range(n)]
    for p_ in paths_:
        ids, at = sp_sampling.ids_of(lattices, p_)
        for r, a, b, log_p, score in zip(p_.row, at[:-1], at[1:], p_.log_prob, sp_sampling.inclusion(p_, last)):
            found[r].append((ids[a:b], log_p, score))
    points = np.array([sp_sampling.MARK, *map(ord, "thin"), sp_sampling.MARK, *map(ord, "air")])
    edges = vocabulary.lattice(points, np.array([5] * 5 + [9] * 4))

    def paths(at, end):
        if at == end:
            yield (), 0.0
            return
        for e in range(edges.first[at], edges.first[at + 1]):
            for rest, p in paths(at + int(edges.size[e]), end):
                yield (int(edges.id[e]), *rest), p + edges.log_p[e]

    every = {a + b: p + q for a, p in paths(0, 5) for b, q in paths(5, 9)}
    total = np.logaddexp.reduce(list(every.values()))
    count = collections.Counter(tuple(r[0][0].tolist()) for r in found)
    for r in found:
        for s, log_p, _ in r:
            assert abs(every[tuple(s.tolist())] - total - log_p) < 1e-9
    for path, p in every.items():
        p = math.exp(p - total)
        assert abs(count[path] / n - p) < 5 * math.sqrt(p * (1 - p) / n) + 2e-3
    # weighing by inclusion gives 1 on average
    assert abs(np.mean([sum(math.exp(p) / s for _, p, s in r) for r in found]) - 1) < 0.02


def test_language_model_counts_are_exact(spark):
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    rows = [r for r in prose(3, 60) + ODD if r[0] is not None]
    tokens = [(i, re.findall(r"[^\x20\x09-\x0D]+", low(t)) + ["\0"]) for i, t in rows]
    held = lambda i: zlib.crc32(str(i).encode()) % 5 == 1
    c = collections.Counter(w for i, ws in tokens for w in ws if not held(i))
    n, v = sum(c.values()), len(c)
    want = sorted((i, held(i), len(ws), sum(w in c for w in ws), n, round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws), 6)) for i, ws in tokens)
    got = lm_bloom.score(docs_of(spark, rows), fold_of() == 1).collect()
    assert sorted((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    assert all(r["score"] < 0 for r in got)


def test_language_model_without_warm_tokens_agrees(spark):
    df = docs_of(spark, prose(4, 40))
    usual = {r["doc_id"]: r["base_score"] for r in lm_bloom.score(df, fold_of() == 1).collect()}
    few = {r["doc_id"]: r["base_score"] for r in lm_bloom.score(df, fold_of() == 1, most_warm=5).collect()}
    assert all(abs(usual[i] - few[i]) < 1e-6 for i in usual)
    nothing = lm_bloom.score(df, F.lit(True)).collect()
    assert {(r["train_tokens"], r["n_known"], round(r["base_score"], 9)) for r in nothing} == {(0, 0, 0.0)}
    assert lm_bloom.score(df.limit(0), fold_of() == 1).count() == 0
    assert lm_bloom.score(df.limit(0), fold_of() == 1, filter_bits=0).count() == 0


def test_language_model_scores_by_all_bigrams(spark):
    rng = np.random.default_rng(13)
    rare = [f"w{i}" for i in range(1500)]
    rows = [" ".join(f"{rare[j]} {rare[(j * 7) % 1500]}" for j in rng.integers(0, 1500, 40)) for _ in range(100)] + [prose(14, 40)[0][1], "", None, "é " * 3000]
    rows = list(enumerate(rows))
    tokens = {i: (t or "").lower().split() + ["\0"] for i, t in rows}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in tokens}
    quantised = lambda n: float(lm_bloom.value(lm_bloom.code(np.array([n])))[0])
    uni = collections.Counter(w for i, ws in tokens.items() for w in ws if not held[i])
    bi = collections.Counter(b for i, ws in tokens.items() for b in zip(["\1", *ws], ws) if not held[i])

    def by_force(count):
        norm, begun = sum(map(count, uni.values())) + 0.5 * (len(uni) + 1), {w: count(n) for w, n in uni.items()} | {"\1": sum(not h for h in held.values())}
        out = {}
        for i, ws in tokens.items():
            c = [(begun.get(v, 0), min(count(bi[v, w]), count(uni[w])), (count(uni[w]) + 0.5) / norm) for v, w in zip(["\1", *ws], ws)]
            out[i] = sum(math.log10((min(vw, v) + lm_bloom.MU * p) / (v + lm_bloom.MU)) for v, vw, p in c)
        return out

    want, exact = by_force(quantised), by_force(float)
    df = docs_of(spark, rows).repartition(3)
    # in a filter so large there are no false positives
    for bits in (1 << 30, 0):
        got = {r["doc_id"]: r["score"] for r in lm_bloom.score(df, fold_of() == 1, shards=16, filter_bits=bits, entry_bits=256).collect()}
        assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-6 for i in want)
    whole, dealt = ({r["doc_id"]: r["score"] for r in lm_bloom.score(df, fold_of() == 1, filter_bits=b).collect()} for b in (1 << 30, 0))
    assert whole.keys() == dealt.keys() and all(abs(whole[i] - dealt[i]) < 1e-9 for i in want)
    # with the parameters as they are, scores are those of the exact model within 0.02 a token
    off = sorted((abs(whole[i] - exact[i]) / len(tokens[i]), len(tokens[i]), i) for i in exact)
    assert off[-1][0] <= 0.02, off[-5:]


@pytest.mark.parametrize("types", [3_000, 40_000, 400_000])
def test_probabilities_sum_to_one(types):
    """Over all types and an unknown one, after tokens that were seen 1 to 10,000 times, with the parameters as they are."""
    rng = np.random.default_rng(17)
    name = rng.integers(0, 2**64, types, dtype=np.uint64)
    n = np.minimum(rng.zipf(1.6, types), 100_000)
    n[:4] = [1, 5, 100, 10_000]
    gram = lambda v, w: tb.mix(tb.mix(name[v] + lm_bloom._BI) + name[w])
    grams, times = [name], [n]
    for v in range(4):  # followers of the four, some of them often
        w, c = np.unique(np.minimum(rng.zipf(1.3, n[v]), types - 1), return_counts=True)
        grams.append(gram(np.full(len(w), v), w))
        times.append(np.minimum(c, n[w]))
        n[v] = times[-1].sum()
    others = np.unique(rng.integers(4, types, 3 * types) * types + rng.integers(0, types, 3 * types))
    grams.append(gram(others // types, others % types))
    times.append(np.ones(len(others), dtype=np.int64))
    grams, codes = np.concatenate(grams), lm_bloom.code(np.concatenate(times))
    checks, shard = lm_bloom.checks_for(types), lm_bloom.shard_of(grams, 64)
    sizes = np.array([lm_bloom.words_for(np.array([lm_bloom.entries_of(codes[shard == i], checks)]))[0] for i in range(64)])
    held = lm_bloom.LogFrequencyFilter(sizes, checks=checks)
    held.add(grams, codes)
    false = held.rate() ** checks * types
    assert false < lm_bloom.MU / 8 or 0.8 < false / (lm_bloom.WORD_RATE * types) < 1.25
    own = lm_bloom.value(held.read(name))
    norm = lm_bloom.value(lm_bloom.code(n)).sum() + 0.5 * (types + 1)
    for v in range(4):
        both = lm_bloom.value(held.read(gram(np.full(types, v), np.arange(types))))
        p = lm_bloom.probability(np.append(both, 0), np.full(types + 1, own[v]), np.append(own, 0), norm, false)
        assert 0.95 < p.sum() < 1.05, (v, p.sum())


def test_language_model_moves_its_ngrams_once(spark, monkeypatch):
    """Each bucket sends its distinct n-grams in a message a part, however many shards there are; levels follow neither."""
    df = docs_of(spark, prose(15, 60) + [(None, None), (None, "a b a b")])
    scores = lambda **k: sorted((r["doc_id"] or 0, round(r["score"], 9), round(r["base_score"], 9), r["n_known"]) for r in lm_bloom.score(df, fold_of() == 1, **k).collect())
    whole = scores()
    monkeypatch.setattr(lm_bloom, "BUCKET_BYTES", 600)
    asked, sent = lm_bloom.asked_of, []
    monkeypatch.setattr(lm_bloom, "asked_of", lambda *a: sent.append((a[2], asked(*a))) or sent[-1][1])
    assert scores(filter_bits=1 << 13) == whole
    parts, messages = sent[0][0], sent[0][1].drop("names", "n").toPandas()
    assert 1 < parts < 100 and messages["bucket"].nunique() > 5
    assert not messages.duplicated(["bucket", "part"]).any() and len(messages) <= parts * messages["bucket"].nunique() and (messages["size"] > 0).all()


def test_language_model_is_the_same_at_any_number_of_types():
    assert {lm_bloom.checks_for(n) for n in (1, 3_000, 34_000, 35_000, 40_000_000)} == {lm_bloom.CHECKS}
    assert lm_bloom.WORD_RATE**lm_bloom.CHECKS * 40_000_000 < 0.01
    v = np.array([1.0, 100.0])
    assert np.allclose(lm_bloom.probability(v * 0, v, v, 1e6, 100.0) * (v + lm_bloom.MU + 100), lm_bloom.MU * (v + 0.5) / 1e6)


def test_packed_numbers_come_back():
    for v in (np.random.default_rng(1).integers(0, 2**64, 1000, dtype=np.uint64), np.arange(7, dtype=np.uint32), np.ones(1, np.uint16)):
        assert np.array_equal(lm_bloom.unpacked(lm_bloom.packed(v), len(v), v.dtype.type), v)


def test_filter_never_reads_too_low():
    rng = np.random.default_rng(0)
    names = np.unique(rng.integers(0, 2**63, 5000).astype(np.uint64))
    codes = lm_bloom.code(n := rng.zipf(1.5, len(names)))
    for checks in (1, 3):
        shard = lm_bloom.shard_of(names, 7)
        f = lm_bloom.LogFrequencyFilter(lm_bloom.words_for(np.array([lm_bloom.entries_of(codes[shard == i], checks) for i in range(7)])), checks=checks)
        f.add(names, codes)
        read = f.read(names)
        assert (read // 8 >= codes // 8).all() and (read == codes).mean() > 0.97
        absent = f.read(rng.integers(2**63, 2**64, 50_000, dtype=np.uint64))
        assert (absent > 0).mean() < (0.03, 0.03, 2e-4)[checks - 1]
    assert np.all(np.abs(np.log2(lm_bloom.value(codes) / n)) <= 1 / 16)


def toxic_sample(seed, n=240):
    rng = np.random.default_rng(seed)
    insults = ["grobnik", "flimwad", "sputterling"]
    rows, labels = [], []
    for i, t in prose(seed, n, 50):
        bad = int(rng.random() < 0.3)
        if bad:
            w = insults[rng.integers(0, 3)]
            if rng.random() < 0.4:
                at = rng.integers(1, len(w))
                w = w[:at] + "*-"[rng.integers(0, 2)] + w[at:]
            plain = t.split()
            t = " ".join([*plain[: len(plain) // 2], w, *plain[len(plain) // 2 :]])
        rows.append((i, t))
        labels.append((i, bad))
    return rows, labels


def test_toxicity_finds_altered_insults_on_held_out_rows(spark):
    rows, labels = toxic_sample(5)
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    got = {r["doc_id"]: r for r in toxicity.score(docs_of(spark, rows + ODD), lab, fold_of() == 0).collect()}
    held = [(got[i]["predicted"], y) for i, y in labels if got[i]["held_out"]]
    assert len(held) > 20 and sum(p == y for p, y in held) / len(held) > 0.95
    assert all(0 <= r["score"] <= 1 for r in got.values()) and got[901]["predicted"] == 0
    probe = docs_of(spark, [(1, "what a g r o b n i k he is"), (2, "a grob-n1k, that"), (3, "a perfectly plain line")])
    assert [r["predicted"] for r in toxicity.score(probe, lab, F.lit(True)).collect()] == [0, 0, 0]  # nothing may be learnt here
    machine = toxicity.fit([t for _, t in rows], [y for _, y in labels])
    raw = [t.encode() for t in ("what a g r o b n i k he is", "a grob-n1k, that", "a perfectly plain line")]
    strongest = machine.strongest(np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(x) for x in raw]))))
    assert (machine.scores(strongest) >= 0.5).tolist() == [True, True, False]


def test_an_insult_of_two_harmless_words_is_found():
    rng = np.random.default_rng(23)
    texts, labels = [], []
    for i, (_, t) in enumerate(prose(24, 400, 60)):
        w, y = t.split(), int(i % 3 == 0)
        for _ in range(2):
            w.insert(int(rng.integers(0, len(w) + 1)), ("wooden spoon" if y else ("wooden", "spoon", "spoon wooden", "a spoon, wooden")[rng.integers(0, 4)]))
        texts.append(" ".join(w))
        labels.append(y)
    machine = toxicity.fit(texts[:250], labels[:250])
    assert machine.pairs
    p = machine.scores(toxicity.strongest_of(machine, texts[250:])) >= 0.5
    y = np.array(labels[250:]) == 1
    assert p[y].mean() > 0.9 and p[~y].mean() < 0.1


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no test tables")
def test_toxicity_of_held_out_documents(spark):
    """No worse than counting words, which had an AUC of 0.92 on these rows."""
    sf = "/root/testdata/sf0.1"
    found = toxicity.op3_toxicity(spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet").where("toxic is not null"), "doc_id").toPandas()
    y, score = found["toxic"].to_numpy() == 1, found["score"].rank().to_numpy()
    assert found["predicted"][y].mean() >= 0.85 and found["predicted"][~y].mean() < 0.01
    assert (score[y].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (~y).sum()) >= 0.92


def test_kernel_features_are_weighted_subsequences():
    words = ["grobnik", "a", "gr-o.bnik", "worthless", "00ps", "xyzzyxyzzyxyz"]
    raw = [w.encode() for w in words]
    end = np.cumsum([len(x) for x in raw])
    start = end - [len(x) for x in raw]
    data = np.frombuffer(b"".join(raw), np.uint8)
    want = []
    for w in raw:
        by = collections.defaultdict(float)
        for i, j, k in itertools.combinations(range(len(w)), 3):
            a, b, c = (int(toxicity.SYMBOL[w[x]]) for x in (i, j, k))
            if a and b and c and k - i < toxicity.SPAN:
                by[(a << 10) | (b << 5) | c] += toxicity.DECAY ** (k - i + 1)
        norm = math.sqrt(sum(v * v for v in by.values()))
        want.append({c: v / norm for c, v in by.items()})
    got = [{} for _ in words]
    for t, c, v in zip(*toxicity.features(data, start, end)):
        got[t][int(c)] = v
    assert all(g.keys() == w.keys() and all(abs(g[c] - w[c]) < 1e-12 for c in w) for g, w in zip(got, want))
    # Nystroem: with all tokens as landmarks the features give the kernel itself
    x = np.zeros((len(words), toxicity.STRINGS))
    for i, w in enumerate(want):
        x[i, list(w)] = list(w.values())
    values, vectors = np.linalg.eigh(x @ x.T)
    z = x @ (x.T @ (vectors / np.sqrt(np.maximum(values, 1e-3))))
    assert np.allclose(z @ z.T, x @ x.T, atol=2e-2)


def test_a_very_long_token_has_the_value_of_its_whole_kernel():
    rng = np.random.default_rng(3)
    machine = toxicity.Machine(rng.normal(size=toxicity.STRINGS), -0.5, np.zeros(3))
    data = rng.integers(33, 127, 3 * toxicity.LONG + 77).astype(np.uint8)
    token, string, value = toxicity.features(data, np.array([5]), np.array([len(data)]))
    assert abs(machine.values(data, np.array([5]), np.array([len(data)]))[0] - max(toxicity.LOWEST, float(value @ machine.weight[string]) - 0.5)) < 1e-9


def test_toxicity_without_labels_or_rows(spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r["predicted"] for r in toxicity.score(docs_of(spark, prose(1, 5)), none, fold_of() == 0).collect()} == {0}
    assert toxicity.score(docs_of(spark, prose(1, 5)).limit(0), none, fold_of() == 0).count() == 0


def test_quality_rejects_junk_and_keeps_columns(spark):
    good = prose(7, 150)
    bad = [(1000 + i, " ".join(w + "***$$"[: 1 + i % 5] for w in t.split())) for i, (_, t) in enumerate(prose(8, 60))]
    labels = [(i, 1) for i, _ in good[:100]] + [(i, 0) for i, _ in bad[:40]] + [(5, None)]
    lab = spark.createDataFrame(labels, "doc_id long, quality int")
    df = docs_of(spark, good + bad + ODD)
    got = {r["doc_id"]: r["keep"] for r in quality_cotrain.score(df, lab).collect()}
    assert np.mean([got[i] for i, _ in good]) > 0.98 and np.mean([got[i] for i, _ in bad]) < 0.05
    kept = quality_cotrain.keep_good(df, lab)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == {i for i, k in got.items() if k}
    assert quality_cotrain.keep_good(df, lab.limit(0)).count() == df.count()
    assert quality_cotrain.keep_good(df.limit(0), lab).count() == 0


def test_cotraining_agrees_with_a_plain_loop():
    rng = np.random.default_rng(21)
    y = (rng.random(60) < 0.6).astype(float)
    views = [y[:, None] * 2 + rng.normal(size=(60, 3)), y[:, None] * 1.5 + rng.normal(size=(60, 2))]
    hidden = (rng.random(500) < 0.6).astype(float)
    pool = [hidden[:, None] * 2 + rng.normal(size=(500, 3)), hidden[:, None] * 1.5 + rng.normal(size=(500, 2))]
    low, high = quality_cotrain.quotas(y, 30)

    def surest(weights):
        out = {}
        for t, v in itertools.product(range(len(weights)), (0, 1)):
            z = quality_cotrain.odds(pool[v], weights[t][v])
            for label, most in ((0, low), (1, high)):
                at = quality_cotrain.surest_of(z, np.arange(500), label, most)
                out[t, v, label] = at, [x[at] for x in pool]
        return out

    got = quality_cotrain.cotrain([(views, y)], surest, rounds=3)[0]
    mine, told = [quality_cotrain.logistic(x, y) for x in views], [{}, {}]
    for _ in range(3):
        for v in (0, 1):
            z = [float(quality_cotrain.odds(p[None], mine[v])[0]) for p in pool[v]]
            told[1 - v] |= {i: 0.0 for i in sorted((i for i in range(500) if z[i] < -2), key=lambda i: (z[i], i))[:low]}
            told[1 - v] |= {i: 1.0 for i in sorted((i for i in range(500) if z[i] > 2), key=lambda i: (-z[i], i))[:high]}
        for v in (0, 1):
            rows = np.vstack([views[v], *[pool[v][i][None] for i in told[v]]])
            mine[v] = quality_cotrain.logistic(rows, np.concatenate([y, list(told[v].values())]), np.concatenate([np.ones(60), np.full(len(told[v]), quality_cotrain.PSEUDO_WEIGHT)]))
    assert all(np.allclose(a, b, atol=1e-4) for a, b in zip(got, mine)) and min(map(len, told)) > 20


def test_the_surest_rows_of_a_table_are_those_of_a_plain_sort(spark):
    rng = np.random.default_rng(22)
    n = 400
    content = rng.normal(size=(n, quality_cotrain.CONTENT))
    meta = [(int(rng.integers(16)), int(rng.integers(64)), float(rng.random() * 9)) for _ in range(n)]
    df = spark.createDataFrame([(i, *meta[i], content[i].tolist()) for i in range(n)], "row long, m_lang int, m_source int, m_chars double, content array<double>").repartition(5)
    record = quality_cotrain._record(*(np.array(x) for x in zip(*meta)))
    weights = [[rng.normal(size=quality_cotrain.CONTENT + 1), rng.normal(size=record.shape[1] + 1)] for _ in range(2)]
    most = [(7, 12), (3, 9)]
    got = quality_cotrain._surest(df, weights, most)
    for (t, v, label), (rows, views) in got.items():
        z = quality_cotrain.odds((content, record)[v], weights[t][v])
        want = sorted((i for i in range(n) if (z[i] > 2 if label else z[i] < -2)), key=lambda i: (-z[i] if label else z[i], i))[: most[t][label]]
        assert rows.tolist() == want and np.allclose(views[0], content[want]) and np.allclose(views[1], record[want])


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def right(kind, value):
    digits = [int(c) for c in value if c in "0123456789"]
    if kind == "ip":
        return all(int(p) <= 255 for p in value.split("."))
    if kind == "card":
        return 14 <= len(digits) <= 19 and sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(digits[::-1])) % 10 == 0
    return kind == "email" or 10 <= len(digits) <= 15


def spans_by_force(text):
    out = [(m.start(), i, m.end(), k) for i, (k, p) in enumerate(PATTERNS.items()) for m in re.finditer(p, text or "") if right(k, m[0])]
    return [f"{k}:{a}:{b}" for a, _, b, k in sorted(out)]


TRICKY = [
    "a@b.c_d@e.f g@h", "x.y@z.co.uk,p@q.r;1.2.3.4.5.6.7.8 300.1.1.1 001.02.3.255", "éé 4111 1111 1111 1111 é +1 (555) 123-4567 4111-1111-1111-1112", "+49 30 1234567 +1 2 +123456789012345678",
    "@a.b a@ a@b a@-.-", "5500005555555559" * 2, "1" * 3000, "a" * 3000 + "@b.c", "1." * 2000, "+1" + " " * 500 + "2345678901", "a@b" + ".c" * 3000, "🎉 me@x.org 🎉10.0.0.1",
]


def test_base_spans_agree_with_the_plain_patterns(spark):
    rng = np.random.default_rng(6)
    noise = ["".join("a1.@+- ()5é"[c] for c in rng.integers(0, 11, 60)) for _ in range(150)]
    rows = list(enumerate(TRICKY + noise)) + ODD
    got = pii_infotheory.sanitised(docs_of(spark, rows).select("doc_id", "text")).select(F.col("p_doc.text").alias("text"), pii_infotheory._listed(F.col("p_base")).alias("s")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["s"] == ",".join(spans_by_force(r["text"])), r["text"]


def test_terms_that_reveal_an_entity_are_sanitised(spark):
    rng = np.random.default_rng(9)
    rows = [(i, t) for i, t in prose(10, 200)]
    for i in range(6):
        rows.append((500 + i, f"meet zorblax at zor{i}@mail.org today {prose(20 + i, 1)[0][1]}".replace(f"zor{i}@", "zor@")))
    rows += [(600 + i, f"today is {rng.integers(100)} fine") for i in range(20)]
    out = {r["doc_id"]: r for r in pii_infotheory.redact(docs_of(spark, rows)).collect()}
    assert "zorblax" not in out[500]["text"] and "zor@mail.org" not in out[500]["text"] and "[EMAIL]" in out[500]["text"] and "today" in out[500]["text"]
    assert out[500]["n_chars"] == len(out[500]["text"])
    assert all(out[i]["text"] == t for i, t in rows if i < 500)
    spans = {r["doc_id"]: r["spans"] for r in pii_infotheory.findings(docs_of(spark, rows)).collect()}
    assert spans[500].startswith("term:0:4,term:5:12,email:16:28") and spans[0] == ""


def test_entities_of_one_and_two_documents_reveal_terms(spark):
    rows = prose(12, 200) + [(500, "ask zorblax one@mail.org today"), (501, "ask Grimbly and grimbly of grimbly@mail.org today")] + [(600 + i, "ask quuxley two@mail.org today") for i in range(2)]
    rows += [(700 + i, "ask today") for i in range(20)]
    out = {r["doc_id"]: r["text"] for r in pii_infotheory.redact(docs_of(spark, rows)).collect()}
    # a word of the only document is no sign of its address, but a part of the address is
    assert out[500] == "ask zorblax [EMAIL] today" and out[501] == "ask [EMAIL NAME] and [EMAIL TERM] of [EMAIL] today"
    assert out[600] == out[601] and "quuxley" not in out[600]
    assert all(out[i] == t for i, t in rows if i < 500)


def test_entities_of_one_and_two_documents_are_protected_in_all_of_a_text(spark):
    stock = [f"wo{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(60)]
    rng = np.random.default_rng(11)
    common = lambda n: " ".join(stock[i] for i in rng.integers(0, 60, n))
    rows = [(i, common(80)) for i in range(300)]
    far = common(60)
    rows.append((500, f"zorblax {far} one@mail.org {far} Zorblax grue"))
    rows += [(600 + i, f"quuxley {common(60)} two@mail.org, quuxley@mail.org") for i in range(2)]
    rows.append((700, "grue " + common(40)))
    out = {r["doc_id"]: r["text"] for r in pii_infotheory.redact(docs_of(spark, rows)).collect()}
    assert out[500] == f"zorblax {far} [EMAIL] {far} Zorblax grue"
    for i in range(2):
        assert "quuxley" not in out[600 + i] and out[600 + i].endswith("[EMAIL], [EMAIL]")
    assert all(out[i] == t for i, t in rows if i < 500 or i == 700)
    counted = {i: set(re.findall(r"[^\W\d_]{3,}", re.sub(PATTERNS["email"], " ", t.lower()))) for i, t in rows}
    held = {i: {m[0].lower() for m in re.finditer(PATTERNS["email"], t)} for i, t in rows}
    total, want = len(rows), set()
    for i, entities in held.items():
        for e in entities:
            n_e = sum(e in x for x in held.values())
            for w in counted[i]:
                n_t, n_et = sum(w in x for x in counted.values()), sum(w in counted[j] and e in held[j] for j in held)
                if n_et < pii_infotheory.SUPPORT and w not in re.findall(r"[^\W\d_]{3,}", e):
                    continue
                given = (n_et + pii_infotheory.PRIOR * n_e / total) / (n_t + pii_infotheory.PRIOR)
                if 1 + math.log(given) / math.log(total / n_e) >= pii_infotheory.GENERALISE:
                    want.add((i, w))
    made = pii_infotheory.sanitised(docs_of(spark, rows)).select(F.col("p_doc.doc_id").alias("doc_id"), F.col("p_doc.text").alias("text"), F.explode("p_terms").alias("t")).collect()
    assert {(r["doc_id"], r["text"][r["t"]["start"] : r["t"]["end"]].lower()) for r in made} == want


def test_findings_leave_out_no_term_for_its_count(spark):
    """A word of the only document of an address is found, as 1 + log(1 / 1.5) / log(222) is above GENERALISE."""
    rows = prose(12, 200) + [(500, "ask zorblax one@mail.org today")] + [(700 + i, "ask today") for i in range(21)]
    found = {r["doc_id"]: r["spans"] for r in pii_infotheory.findings(docs_of(spark, rows)).collect()}
    assert found[500] == "term:4:11,email:12:24" and found[0] == ""


def test_a_list_of_addresses_is_one_group(spark):
    names = [f"{chr(97 + i // 676)}{chr(97 + i // 26 % 26)}{chr(97 + i % 26)}x" for i in range(4000)]
    contacts = " ".join(f"{n} {n}@mail.org" for n in names)
    rows = [(1, contacts), (2, contacts), (3, f"{contacts} again")] + [(10 + i, f"word{chr(97 + i % 26)} here") for i in range(200)]
    found = {r["doc_id"]: (r["n_email"], r["n_term"]) for r in pii_infotheory.findings(docs_of(spark, rows)).collect()}
    assert found[1] == found[2] == (4000, 4000) and found[3][0] == 4000 and found[10] == (0, 0)
    docs = docs_of(spark, rows).select("doc_id", "text")
    base = docs.withColumn("p_base", pii_infotheory.base_spans(F.col("text"))).withColumnRenamed("text", "p_text").withColumn("p_row", F.col("doc_id"))
    near = base.where(F.size("p_base") > 0)
    terms = pii_infotheory.revealing_terms(near, base.where(F.size("p_base") == 0), float(len(rows)))
    assert terms.count() == 3 * 4000


def test_personal_data_of_nothing(spark):
    df = docs_of(spark, [(1, "a@b.c")]).limit(0)
    assert pii_infotheory.findings(df).count() == 0 and pii_infotheory.redact(df).columns == df.columns
