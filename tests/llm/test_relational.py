"""Exact dedup, Jaccard join, search and chat formatting against brute force, with odd inputs."""

import hashlib
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from veldspar.llm import chat_format, exact_dedup, jaccard_join, topk_maxscore
from veldspar.llm import textbytes as tb
from veldspar.llm.components import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, r_id string, node string"


def docs_of(spark, rows):
    """Documents with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, "en", "s", None, "x", "y") for i, t in rows], DOCS)


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingles(text, k):
    w = words_of(text)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def grouped_by_force(rows, k, percent):
    sets = {i: shingles(t, k) for i, t in rows}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def variants(seed, n=60, length=40):
    """Families of texts with a few changed words, some cut, some doubled, and a passage in many of them."""
    rng = np.random.default_rng(seed)
    word = lambda: "".join(chr(97 + c) for c in rng.integers(0, 6, rng.integers(1, 4)))
    passage = " ".join(word() for _ in range(15))
    base = [[word() for _ in range(length)] for _ in range(5)]
    out = []
    for i in range(n):
        w = list(base[rng.integers(0, 5)])
        for _ in range(rng.integers(0, 4)):
            w[rng.integers(0, len(w))] = word()
        out.append((i, " ".join(w) + (" " + passage if rng.random() < 0.4 else "")))
    return out


ODD = [(1000, None), (1001, ""), (1002, " \n\t "), (1003, "one"), (1004, "ONE"), (1005, "one two"), (1006, "é ü"), (1007, "x" * 5000), (1008, "x" * 5000), (1009, "a b c " * 700), (1010, "a b c " * 701)]


@pytest.mark.parametrize("k,percent,tile", [(3, 90, 1024), (5, 80, 4), (2, 60, 7)])
def test_jaccard_groups_agree_with_brute_force(spark, k, percent, tile):
    rows = variants(k) + ODD
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_groups(docs_of(spark, rows).repartition(3), k, percent, tile).collect()}
    assert got == grouped_by_force(rows, k, percent)


def test_jaccard_join_on_empty_tables_and_null_ids(spark):
    assert jaccard_join.jaccard_groups(docs_of(spark, [(1, "a")]).limit(0), 3, 90).count() == 0
    assert jaccard_join.keep_representatives(docs_of(spark, [(1, "a")]).limit(0)).count() == 0
    got = jaccard_join.jaccard_groups(docs_of(spark, [(None, "a b c d"), (5, "a b c d"), (5, "a b c d")]), 3, 90).collect()
    assert {r["component_id"] for r in got} == {5} and len(got) == 3


def test_representatives_keep_columns_and_the_least_id(spark):
    rows = [(7, "a b c d e f g h i j k l"), (3, "a b c d e f g h i j k l"), (9, "z y x w v u")]
    out = jaccard_join.keep_representatives(docs_of(spark, rows))
    assert sorted(r["doc_id"] for r in out.collect()) == [3, 9] and out.columns == DOCS.replace(" long", "").replace(" string", "").split(", ")


def test_signature_bounds_the_overlap():
    rng = np.random.default_rng(2)
    for _ in range(50):
        a, b = (np.unique(rng.integers(0, 300, rng.integers(1, 200)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) for _ in range(2))
        apart = int(np.bitwise_count(jaccard_join.signature(a) ^ jaccard_join.signature(b)).sum())
        assert len(np.intersect1d(a, b)) == jaccard_join.overlap(a, b) <= (len(a) + len(b) - apart) // 2


def test_words_match_the_pattern():
    texts = ["", "A b\tC\x0bd", "  lead", "trail \r\n", "ÀB ç", "x\x1fy", "word" * 300]
    raw = [t.encode() for t in texts]
    data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], np.cumsum([len(x) for x in raw])))
    w = tb.words(data, offsets)
    seen = {}
    for r, t in enumerate(texts):
        mine = w.name[w.first[r] : w.first[r + 1]]
        assert len(mine) == len(words_of(t))
        for name, word in zip(mine.tolist(), words_of(t)):
            assert seen.setdefault(name, word) == word


def test_components_of_a_path_a_star_and_loops(spark):
    edges = [(i, i + 1) for i in range(20)] + [(100, 100 + i) for i in range(1, 30)] + [(7, 7), (None, 3)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(21)} | {100 + i: 100 for i in range(30)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_exact_groups_agree_with_brute_force(spark):
    long = "ab" * 40_000
    rows = variants(1)[:20] + ODD + [(2000 + i, "same" * 30) for i in range(7)] + [(3000, long), (3001, long), (3002, long + "!"), (3003, "b" * 64), (3004, "b" * 64), (3005, "b" * 65), (3006, "b" * 576), (3007, "b" * 576)]
    by = {}
    for i, t in rows:
        by.setdefault(t or "", []).append(i)
    got = {r["doc_id"]: tuple(r)[1:] for r in exact_dedup.exact_groups(docs_of(spark, rows)).collect()}
    assert got == {i: (max(by[t or ""]), len(by[t or ""]), i == max(by[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows}


def test_exact_dedup_of_repeated_rows_and_empty_tables(spark):
    rows = [(1, "a"), (1, "a"), (2, "b"), (None, "b"), (4, None), (3, "")]
    df = docs_of(spark, rows)
    assert sorted(r["doc_id"] for r in exact_dedup.keep_one(df).collect()) == [1, 2, 4]
    assert exact_dedup.keep_one(df).columns == df.columns
    got = sorted(((r["doc_id"] or 0), r["group_size"], r["kept"]) for r in exact_dedup.exact_groups(df).collect())
    assert got == [(0, 2, False), (1, 2, True), (1, 2, True), (2, 2, True), (3, 2, False), (4, 2, True)]
    assert exact_dedup.exact_groups(df.limit(0)).count() == 0


def test_search_agrees_with_brute_force(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(90, 8)).astype(np.float32)
    x[10:20] = x[5]
    rows = [(i, [float(c) for c in v], "e") for i, v in enumerate(x)]
    bad = [(200, None, "e"), (201, [1.0, None], "e"), (202, [float("inf")] * 8, "e"), (203, [float("nan")] * 8, "e"), (None, [1.0] * 8, "e")]
    df = spark.createDataFrame(rows + bad + rows[30:32], "vec_id long, embedding array<float>, codes string").repartition(3)
    codes = np.floor(64 * x.astype(float)).astype(int)
    for shard, group in ((4096, 512), (16, 3)):
        got = topk_maxscore.top_k(df, F.col("vec_id") % 10 == 0, k=6, shard=shard, group=group).collect()
        want = []
        for q in range(0, 90, 10):
            score = codes @ codes[q]
            order = [i for i in np.lexsort((np.arange(90), -score)) if i != q][:6]
            want += [(q, r + 1, int(i), int(score[i])) for r, i in enumerate(order)]
        assert sorted(tuple(r) for r in got) == sorted(want)


def test_search_skips_postings_and_stays_exact():
    rng = np.random.default_rng(6)
    scale = np.array([40.0] * 3 + [2.0] * 29)  # a few strong terms
    x = np.floor(rng.normal(size=(6000, 32)) * scale).astype(np.int64)
    best, held, read = topk_maxscore.Best(np.arange(20), x[:20], 10), 0, 0
    for a in range(0, 6000, 2000):
        more = best.add(np.arange(a, a + 2000), x[a : a + 2000])
        held, read = held + more[0], read + more[1]
    assert read < 0.5 * held
    for q in range(20):
        score = x @ x[q]
        want = [i for i in np.lexsort((np.arange(6000), -score)) if i != q][:10]
        assert best.ids[q].tolist() == want and best.scores[q].tolist() == score[want].tolist()


def test_search_with_few_rows(spark):
    kind = "vec_id long, embedding array<float>"
    assert topk_maxscore.top_k(spark.createDataFrame([], kind), F.lit(True)).count() == 0
    df = spark.createDataFrame([(0, [1.0]), (1, [-1.0]), (2, [])], kind)
    got = sorted(tuple(r) for r in topk_maxscore.top_k(df, F.col("vec_id") == 0, k=5).collect())
    assert got == [(0, 1, 2, 0), (0, 2, 1, -4096)]


def test_branches_of_a_reply_tree_are_ranked(spark):
    rows = [("r", None, "user", "hi", 0.0), ("a", "r", "assistant", "A", 1.0), ("b", "r", "assistant", "B", 3.0), ("c", "a", "user", "C", 5.0), ("z", "gone", "user", "Z", 0.0)]
    nodes = spark.createDataFrame([(n, p, "t" if n != "z" else "u", r, x, s) for n, p, r, x, s in rows], "node string, parent string, tree string, role string, text string, score double")
    got = {(r["tree"], r["branch"]): [t["text"] for t in r["turns"]] for r in chat_format.read_back(chat_format.conversations(nodes, branches=2)).collect()}
    assert got == {("t", 1): ["hi", "A", "C"], ("t", 2): ["hi", "B"], ("u", 1): ["Z"]}


def test_any_text_survives_formatting_and_the_mask_is_exact(spark):
    said = ["<|im_end|>", "\\", "\\\\n", "<\\|", "<<||", "", "é🎉<|im_start|>assistant\nok", "a\n<|im_end|>\n", None, "tail\\"]
    roles = ["user", "assistant", "as\nsist\\n<|", None, "assistant\\"]
    rows = [(c, t, roles[(c + t) % 5], said[(3 * c + t) % 10], "x") for c in range(10) for t in range(c + 1)] + [(4, 2, "assistant", "again", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, node string")
    want = {}
    for c, _, r, t, _ in sorted(rows, key=lambda x: (x[0], x[1], x[2] or "", x[3] or "")):
        want.setdefault(c, []).append((r or "", t or ""))
    out = chat_format.read_back(chat_format.conversations(chat_format.chains(df))).collect()
    assert len(out) == len(want)
    for r in out:
        turns = [tuple(t) for t in r["turns"]]
        assert sorted(turns) == sorted(want[r["tree"]]) and r["n_turns"] == len(turns)
        assert r["loss_text"] == "".join(t for role, t in turns if role == "assistant")
        blocks = [r["formatted"][s["start"] : s["end"]] for s in r["spans"]]
        assert len(blocks) == sum(role == "assistant" for role, _ in turns) and not any("<|" in b for b in blocks)


def test_chat_formatting_of_nothing(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat_format.conversations(chat_format.chains(df)).count() == 0
