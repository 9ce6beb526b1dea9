"""Clashing columns, map columns, circles, repeated ids, structured and very long texts, threads."""

import threading
import tracemalloc

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from test_text import prose
from veldspar.llm import chat_format, common, exact_dedup, jaccard_join, lm_bloom, packing, pii_infotheory, quality_cotrain, sp_sampling
from veldspar.llm import textbytes as tb

CLASH = ["k_0", "away_id", "p_text", "p_new", "p_row", "p_doc", "own_row", "r_id", "r_row", "of_id", "m_lang", "key", "node", "y", "row"]
#: Strings of two letters that sums of powers of any odd base can't tell apart.
MORSE = ["".join("ab"[bin(i).count("1") % 2] for i in range(1 << k)) for k in (10, 12)]


def docs_of(spark, rows):
    kind = "doc_id long, text string, lang string, source string, n_chars long, tags map<string,int>, " + ", ".join(f"{c} string" for c in CLASH)
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), {"a": 1}, *["x"] * len(CLASH)) for i, t in rows], kind)


def test_stages_keep_clashing_and_map_columns(spark, tmp_path):
    rows = prose(31, 30, 80) + [(100, "mail me@x.org now"), (101, None), (102, ""), (103, "same text here"), (104, "same text here"), (104, "same text here")]
    docs = docs_of(spark, rows)
    spark.createDataFrame([(i, 1) for i in range(20)] + [(i, 0) for i in range(20, 26)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema], name
        got = out.collect()
        assert got and all(r["k_0"] == "x" and r["p_new"] == "x" and r["tags"] == {"a": 1} for r in got), name
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
    assert [r["doc_id"] for r in exact_dedup.keep_one(docs).where("text = 'same text here'").collect()] == [104]
    assert "[EMAIL]" in pii_infotheory.redact(docs).where("doc_id = 100").first()["text"]


def test_a_hash_sample_is_whole_at_any_size_and_skew(spark):
    rows = spark.range(1_000_000).select(F.col("id").alias("i"), F.col("id").alias("row"))
    got = [r["i"] for r in common.hash_sample(rows, "i", 240, "row").collect()]
    assert sorted(got) == sorted(r["i"] for r in rows.orderBy(F.xxhash64("i")).limit(240).collect()) and len(got) == 240
    one = spark.range(15_000).select(F.lit(7).cast("long").alias("i"), F.col("id").alias("row"))
    both = one.union(spark.range(8, 4000).select("id", "id"))
    assert common.hash_sample(both, "i", 12_000, "row").count() == 12_000 and common.hash_sample(both, "i", 20_000, "row").count() == both.count()
    assert common.hash_sample(one, "i", 100, "row", parts=4).count() == 100


def test_structured_texts_have_names_of_their_own(spark):
    for a in MORSE:
        b = a.translate(str.maketrans("ab", "ba"))
        raw = [a.encode(), b.encode()]
        data, at = np.frombuffer(b"".join(raw), np.uint8), np.array([0, len(a), 2 * len(a)])
        w = tb.words(data, at, 2)
        assert w.name[0] != w.name[1] and w.other[0] != w.other[1]
        docs = spark.createDataFrame([(1, a), (2, b), (3, a)], "doc_id long, text string")
        assert {r["doc_id"]: r["component_id"] for r in jaccard_join.jaccard_groups(docs, 3, 90).collect()} == {1: 1, 2: 2, 3: 1}
        pieces = {}
        for r in packing.pack(docs, packing.vocabulary_path("byte_bpe_50k.tiktoken")).collect():
            pieces.setdefault(r["doc_id"], []).append((r["start"], r["ids"]))
        ids = {i: b"".join(x for _, x in sorted(p)) for i, p in pieces.items()}
        assert ids[1] == ids[3] != ids[2]
        path = packing.vocabulary_path("piece_bpe_32k.model")
        assert {(r["doc_id"], r["text"]) for r in sp_sampling.decode(sp_sampling.encode(docs, path, 2), path).collect()} == {(1, a), (2, b), (3, a)}
        scored = lm_bloom.score(docs, F.col("doc_id") == 2).collect()
        assert {r["doc_id"]: r["n_known"] for r in scored} == {1: 2, 2: 1, 3: 2}


def test_a_repeated_id_loses_no_link(spark):
    base = [f"w{i}" for i in range(100)]
    near = " ".join([*base[:99], "other"])
    rows = [(1, "a b c d e f"), (2, "a b c d e f"), (2, " ".join(base)), (3, near)]
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90).collect())
    assert got == [(1, 4, 1), (2, 4, 1), (2, 98, 2), (3, 98, 2)]
    kept = jaccard_join.keep_representatives(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90).collect()
    assert sorted((r["doc_id"], len(r["text"])) for r in kept) == sorted([(1, 11), (2, len(" ".join(base)))])


def test_ids_of_the_join_may_be_text(spark):
    docs = spark.createDataFrame([("b", "a b c d"), ("a", "a b c d"), (None, "x y z"), ("c", None)], "doc_id string, text string")
    assert {r["doc_id"]: r["component_id"] for r in jaccard_join.jaccard_groups(docs, 3, 90).collect()} == {"b": "a", "a": "a", None: None, "c": "c"}


def test_sets_that_share_a_first_digest_go_by_the_second(spark):
    rows = [(i, f"p{i} q{i} r{i} s{i}") for i in range(4)] + [(9, "p1 q1 r1 s1")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    real = {r["doc_id"]: r for r in jaccard_join.nodes_of(docs.withColumn("key", F.lit(0).cast("long")), 3).collect()}
    clash = frozenset({real[1]["node"]})
    nodes = {r["node"] for r in jaccard_join.sets_of(docs.where("doc_id in (1, 2)"), 3, clash).collect()}
    assert nodes == {real[1]["other"], real[2]["node"]} and real[1]["other"] == real[9]["other"]


@pytest.mark.parametrize("n", [700, 1500])
def test_large_clusters_lose_no_link(spark, n):
    rng = np.random.default_rng(n)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(n):  # edits of one text: some pairs link only by way of others
        w = list(base)
        for at in rng.choice(200, rng.integers(1, 9), replace=False):
            w[at] = f"x{rng.integers(40)}"
        rows.append((i, " ".join(w)))
    from test_relational import shingles

    sets = [shingles(t, 3) for _, t in rows]
    index = {s: j for j, s in enumerate(sorted(set().union(*sets)))}
    x = np.zeros((n, len(index)), dtype=np.float32)
    for i, s in enumerate(sets):
        x[i, [index[y] for y in s]] = 1
    both = x @ x.T
    size = x.sum(axis=1)
    a, b = np.nonzero(np.triu(100 * both >= 90 * (size[:, None] + size[None] - both), 1))
    from veldspar.llm.components import labelled

    least = dict(zip(*(v.tolist() for v in labelled(a, b))))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.jaccard_groups(docs, 3, 90, tile=64).collect()}
    assert got == {i: least.get(i, i) for i in range(n)}


def test_circles_belong_to_no_tree(spark):
    rows = [("a", "b"), ("b", "c"), ("c", "a"), ("d", "a"), ("s", "s"), ("r", None), ("x", "r"), ("y", "x"), ("z", "gone")]
    nodes = spark.createDataFrame([(n, p, "t", "user", n, 0.0) for n, p in rows], "node string, parent string, tree string, role string, text string, score double")
    got = chat_format.read_back(chat_format.conversations(nodes, branches=9)).collect()
    assert sorted([t["text"] for t in r["turns"]] for r in got) == [["r", "x", "y"], ["z"]]
    only = chat_format.conversations(nodes.where("node in ('a', 'b', 'c', 's')"))
    assert only.count() == 0


def test_a_conversation_called_null_is_not_a_null_one(spark):
    rows = [("null", 0, "user", "a"), (None, 0, "user", "b"), ("null", 1, "assistant", "c"), (None, 1, "assistant", "d")]
    df = spark.createDataFrame(rows, "conv_id string, turn long, role string, text string")
    got = chat_format.read_back(chat_format.conversations(chat_format.chains(df))).collect()
    assert {r["tree"]: [t["text"] for t in r["turns"]] for r in got} == {"null": ["a", "c"], None: ["b", "d"]}


def test_many_matches_in_a_text_lie_where_they_are(spark):
    text = " ".join(f"u{i}@x.org, é" for i in range(2000))
    row = pii_infotheory.sanitised(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    spans = row["p_base"]
    assert len(spans) == 2000 and all(text[s["start"] : s["end"]] == f"u{i}@x.org" for i, s in enumerate(spans))


def test_a_long_text_takes_a_few_times_its_size():
    rng = np.random.default_rng(1)
    n = 16_000_000
    data = rng.integers(97, 123, n).astype(np.uint8)
    data[rng.integers(0, n, n // 6)] = 32
    tracemalloc.start()
    w = tb.words(data, np.array([0, n]), 2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(w.name) > 1_000_000 and peak < 12 * n
    tokenizer = packing.Tokenizer(packing.vocabulary_path("byte_bpe_50k.tiktoken"))
    some, at = data[:3_000_000], np.array([0, 1_000_000, 1_000_000, 3_000_000])
    whole, pieces = tokenizer.encode(some, at, 10_000_000), tokenizer.encode(some, at, 50_000)
    assert all(np.array_equal(a, b) for a, b in zip(whole, pieces))
    x = quality_cotrain.describe(some, at)
    assert np.allclose(x[:, :9].sum(axis=1), [1, 0, 1])


def test_threads_have_scopes_of_their_own(spark):
    kept, errors = [], []

    def work(i):
        try:
            with common.scope(spark):
                first = common.durable(spark.range(i + 1))
                out = common.durable(first.selectExpr("id + 1 AS id"), keep=True)
            kept.append((i, out.count()))
        except Exception as e:  # noqa: BLE001
            errors.append(e)

    threads = [threading.Thread(target=work, args=(i,)) for i in range(4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert not errors and sorted(kept) == [(i, i + 1) for i in range(4)]
