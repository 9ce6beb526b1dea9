import corpus_pipeline
import numpy as np

from test_text import DOCS, prose


def test_stages_keep_the_columns_and_take_effect(spark, tmp_path):
    good = [(i, t) for i, t in prose(11, 120, 80)]
    junk = [(300 + i, " ".join(w + "%%%" for w in t.split())) for i, (_, t) in enumerate(prose(12, 40))]
    copies = [(400 + i, good[5][1]) for i in range(5)]
    private = [(450, "write to someone@example.org or 10.1.2.3 " + good[7][1])]
    rows = good + junk + copies + private + [(460, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", "y") for i, t in rows], DOCS).select("doc_id", "text", "lang", "source", "n_chars")
    spark.createDataFrame([(i, 1) for i, _ in good[:80]] + [(i, 0) for i, _ in junk[:30]], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    seen = []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        if i < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / f"stage{i}"))
        docs = spark.read.parquet(str(tmp_path / f"stage{i}"))
        seen.append((name, {r["doc_id"] for r in docs.collect()}, docs))
    assert not any(300 <= i < 340 for i in seen[0][1]) and len([i for i in seen[0][1] if i < 120]) > 115
    assert 404 in seen[1][1] and 5 not in seen[1][1]
    text = {r["doc_id"]: r["text"] for r in seen[3][2].collect()}
    assert all("@" not in (t or "") for t in text.values()) and np.all([i in seen[4][1] for i in text])


def test_run_over_files(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.count() > 0 and {"doc_id", "start", "length", "sequence_id"} <= set(out.columns)
