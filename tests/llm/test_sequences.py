"""Prefix tries, hard negatives and language chains against brute force, with odd inputs."""

import hashlib
import itertools
import os
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from veldspar.llm import hard_negatives, language_crf, prefix_trie
from veldspar.llm.common import fold_of

SF = "/root/testdata/sf0.01"


def nodes_by_force(rows):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append(((turn is not None, turn or 0), role or "", text or ""))
    own = {c: [(r, x) for _, r, x in sorted(t)] for c, t in convs.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        built[c] = own.get(c - int(np.fmod(c, 20)), [])[:h] + turns[h:]
    members = {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    out = []
    for path, own_ in members.items():
        below = [p for p in members if p[: len(path)] == path]
        kids = [p for p in below if len(p) == len(path) + 1]
        leaves = [p for p in below if not any(len(x) == len(p) + 1 and x[: len(p)] == p for x in below)]
        saved = sum((len(members[p]) - 1) * (len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0) for p in below)
        ends = ",".join(str(c) for c in sorted(c for c in own_ if len(built[c]) == len(path)))
        out.append((min(own_), len(path), min(members[path[:-1]]) if path else None, len(own_), len(kids), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


CONV = "conv_id long, turn long, role string, text string, key string, n long"


def conversations(seed, n):
    """Turns from few texts, so that beginnings are shared; a third of all conversations are copies of one."""
    rng = np.random.default_rng(seed)
    out = []
    for c in range(-7, n):
        size = int(rng.integers(1, 7))
        if c % 3 == 0:
            out += [(c, t, "user", f"same {t}", "x", 1) for t in range(4)]
        else:
            out += [(c, int(t) if t else None, None if rng.random() < 0.1 else "user", None if rng.random() < 0.1 else "w " * int(rng.integers(0, 3)), "x", 1) for t in range(size)]
    return out + [(None, 1, "user", "nobody", "x", 1)]


@pytest.mark.parametrize("limit", [1, 4, 200])
def test_trie(spark, limit):
    rows = conversations(3, 90)
    found = prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.sequences(spark.createDataFrame(rows, CONV))), limit=limit, bucket=16).collect()
    assert sorted((tuple(r) for r in found), key=str) == nodes_by_force([r[:4] for r in rows])


def test_trie_of_a_long_conversation_and_of_none(spark):
    rows = [(c, t, "user", f"turn {t}", "x", 1) for c in (5, 25) for t in range(3000)]
    found = prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.sequences(spark.createDataFrame(rows, CONV)))).agg(F.count("*"), F.max("depth"), F.max("n_leaves")).first()
    shorter = 3000 - min(zlib.crc32(b"5") % 4, zlib.crc32(b"25") % 4)
    assert found[1] == shorter and found[0] >= shorter
    assert prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.sequences(spark.createDataFrame([], CONV)))).count() == 0


def mined_by_force(rows, k=5):
    v = {}
    for i, x, label in rows:
        if i is not None and label is not None and x is not None and all(c is not None and np.isfinite(c) for c in x):
            v.setdefault(i, []).append((label, np.floor(256 * np.asarray(x, dtype=np.float32).astype(float)).astype(int)))
    out = []
    for a in v:
        if a % 100:
            continue
        label, q = min(v[a], key=lambda r: (r[0], r[1].tolist()))
        best = lambda want: sorted(((-max(s), i) for i in v if i != a for s in [[int(c @ q) for own, c in v[i] if want(own, int(c @ q))]] if s))[:k]  # noqa: B023, E731
        for s, p in best(lambda own, _: own == label):  # noqa: B023
            near = best(lambda own, x, top=-s: own != label and 80 * top <= 100 * x <= 100 * top)  # noqa: B023
            out += [(a, p, r + 1, i, -s, -x) for r, (x, i) in enumerate(near)]
    return sorted(out)


VECTORS = "vec_id long, embedding array<float>, label int, slot int"


def vectors(seed, n=420, dims=24, strong=4):
    """A few strong directions; a third of the rows are one vector, some ids and rows are repeated, some aren't whole."""
    rng = np.random.default_rng(seed)
    turn = np.linalg.qr(rng.normal(size=(dims, dims)))[0]
    x = (rng.normal(size=(n, dims)) * np.where(np.arange(dims) < strong, 0.5, 0.05)) @ turn
    x[::3] = x[0]
    rows = [(i, x[i].tolist(), int(rng.integers(0, 4)), 0) for i in range(n)]
    rows += [(10, x[5].tolist(), 1, 0), (10, x[5].tolist(), 1, 0), (100, x[7].tolist(), 3, 0), (None, x[1].tolist(), 1, 0), (901, None, 1, 0), (902, [float("nan")] * dims, 1, 0), (903, [None] * dims, 1, 0), (904, x[2].tolist(), None, 0)]
    return rows


@pytest.mark.parametrize("group", [2, 1000])
def test_hard_negatives(spark, group):
    rows = vectors(5)
    coded = hard_negatives.labelled_codes(spark.createDataFrame(rows, VECTORS).repartition(3), 256, F.col("label"))
    found = hard_negatives.mine(coded, F.col("vec_id") % 100 == 0, group=group, block=64).collect()
    assert sorted(tuple(r) for r in found) == mined_by_force([r[:3] for r in rows])
    assert hard_negatives.mine(coded.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_rotation_discards_early_and_its_bounds_hold():
    rows = [r for r in vectors(6, 3000) if r[0] is not None and r[1] is not None and r[2] is not None]
    x = np.floor(256 * np.array([r[1] for r in rows if None not in r[1]], dtype=float)[:3000]).astype(np.int64)
    turn = hard_negatives.rotation(x[:500])
    w = hard_negatives.Wanted(np.arange(0, 3000, 100), np.zeros(30, np.int64), x[::100], np.full((30, 1), hard_negatives.NONE + 1), np.full((30, 1), -hard_negatives.NONE), True, 5)
    lists = hard_negatives.Lists(w, turn)
    for a in range(0, 3000, 500):
        lists.add(np.arange(a, a + 500), np.zeros(500, np.int64), x[a : a + 500])
    for i in range(30):
        s = x @ x[100 * i]
        order = [j for j in np.lexsort((np.arange(3000), -s)).tolist() if j != 100 * i][:5]
        assert lists.ids[i, 0].tolist() == order and lists.scores[i, 0].tolist() == s[order].tolist()
    assert lists.read < 0.9 * lists.pairs
    q, c = hard_negatives.Rotated(x[:40], turn), hard_negatives.Rotated(x[40:140], turn)
    everything = np.full(40, -1e18), np.full(40, 1e18)
    i, j, score, _ = hard_negatives.survivors(q, c, *everything, np.ones((40, 100), bool), hard_negatives.slack_of(turn))
    assert len(i) == 4000 and (score == (x[:40] @ x[40:140].T)[i, j]).all()


def test_forward_backward_against_enumeration():
    rng = np.random.default_rng(2)
    length = np.array([4, 3, 1])
    e, t = rng.normal(size=(3, 4, 3)) * 2, rng.normal(size=(3, 3))
    marginal, pairs, log_z = language_crf.forward_backward(e, t, length)
    want, want_pairs = np.zeros_like(e), np.zeros((3, 3))
    for c, n in enumerate(length):
        paths = list(itertools.product(range(3), repeat=int(n)))
        s = np.array([sum(e[c, i, y] for i, y in enumerate(p)) + sum(t[a, b] for a, b in zip(p, p[1:])) for p in paths])
        assert np.isclose(log_z[c], np.log(np.exp(s).sum()))
        for p, w in zip(paths, np.exp(s - log_z[c])):
            for i, y in enumerate(p):
                want[c, i, y] += w
            for a, b in zip(p, p[1:]):
                want_pairs[a, b] += w
    assert np.allclose(marginal, want) and np.allclose(pairs, want_pairs)


def invented(seed):
    """Three languages of syllables of their own, with some in common."""
    rng = np.random.default_rng(seed)
    syllables = [["ka", "ro", "ti", "an"], ["schu", "ber", "ung", "an"], ["eau", "lle", "é", "an"]]
    word = lambda k: "".join(rng.choice(syllables[k], rng.integers(1, 4)))
    return lambda k, n: " ".join(word(k) for _ in range(n))


LANG = "doc_id long, text string, lang string, lettered string"


def test_language_of_switched_odd_and_missing_texts(spark):
    say = invented(4)
    rows = [(i, say(i % 3, 40), "abc"[i % 3], "x") for i in range(240)]
    odd = [(1000, None, "a", "x"), (1001, "", "a", "x"), (1002, "12 34 … !?", "b", "x"), (None, say(1, 30), None, "x"), (1003, f"{say(0, 30)} {say(1, 30)}", None, "x"), (1004, "schuber" * 40_000, None, "x"), (1005, f"ÉEAU {say(2, 300)}", None, "x"), (7, say(1, 30), "c", "x"), (7, say(1, 30), "c", "x")]
    docs = spark.createDataFrame(rows + odd, LANG)
    found = language_crf.identify(docs, fold_of() == 0).collect()
    assert len(found) == len(rows) + len(odd)
    known = {r[0]: r[2] for r in rows}
    fresh = [r for r in found if r["held_out"] and r["doc_id"] in known and r["doc_id"] != 7]
    assert len(fresh) > 30 and sum(r["lang_pred"] == known[r["doc_id"]] for r in fresh) >= 0.97 * len(fresh)
    by = {r["doc_id"]: r for r in found}
    assert [by[i]["lang_pred"] for i in (1000, 1001, 1002)] == ["und"] * 3 and [by[i]["score"] for i in (1000, 1001, 1002)] == [0.0] * 3
    assert [by[i]["lang_pred"] for i in (None, 1004, 1005)] == ["b", "b", "c"]
    mixed = by[1003]
    assert abs(mixed["shares"]["a"] - 0.5) < 0.1 and 0.4 < mixed["score"] < 0.65 and mixed["n_words"] == 60
    label = [run["lang"] for run in mixed["runs"] for _ in range(run["first"], run["last"])]
    assert len(label) == 60 and sum(x == y for x, y in zip(label, "a" * 30 + "b" * 30)) >= 57
    assert all(0 <= r["score"] <= 1 for r in found)


def test_language_without_and_with_one_language(spark):
    rows = [(i, "some words here", "en", "x") for i in range(20)]
    docs = spark.createDataFrame(rows + [(100, "", None, "x")], LANG)
    one = {r["doc_id"]: r for r in language_crf.identify(docs, fold_of() == 0, runs=False).collect()}
    assert one[1]["lang_pred"] == "en" and one[1]["score"] == 1.0 and one[100]["lang_pred"] == "und"
    none = language_crf.identify(docs.withColumn("lang", F.lit(None).cast("string")), fold_of() == 0).collect()
    assert len(none) == 21 and {(r["lang_pred"], r["score"]) for r in none} == {("und", 0.0)}
    assert language_crf.identify(docs.limit(0), fold_of() == 0).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_language_of_held_out_documents(spark):
    found = language_crf.op11_language_crf(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out and lang is not null")
    n, right = found.agg(F.count("*"), F.sum((F.col("lang") == F.col("lang_pred")).cast("int"))).first()
    assert n > 100 and right >= 0.97 * n
