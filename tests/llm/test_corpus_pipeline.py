"""The pipeline on a small corpus with one planted case for each stage."""

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline


def test_stages_and_run(spark, tmp_path):
    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in range(500)]
    rows, labels = [], []
    for i in range(900):
        w = list(rng.choice(words, 60))
        bad = i % 6 == 0
        if bad:
            for at in rng.choice(60, 4):
                w[at] = rng.choice(["vile", "scum", "rotten"])
        rows.append((i, " ".join(w), "en", "s", 1))
        labels.append((i, 1, int(bad)))
    passage = " ".join(f"bench{i}" for i in range(20))
    clean = " ".join(rng.choice(words, 80))
    rows += [(1000, clean, "en", "s", 1), (1001, clean + " extra", "en", "s", 1), (1002, f"{passage} and more", "en", "s", 1), (1003, "write to a.b@example.org or +49 30 1234567 today", "en", "s", 1), (1004, None, None, None, None), (1005, "", "en", "s", 0), (1006, "vile scum rotten vile", "en", "s", 1)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, f in corpus_pipeline.STAGES:
        f(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / f"out-{name}"))
        docs = spark.read.parquet(str(tmp_path / f"out-{name}"))
        if name != "packing":
            assert docs.columns == corpus_pipeline.COLUMNS
            seen[name] = {r.doc_id: r.text for r in docs.collect()}
    bad = {r[0] for r in labels if r[2]} | {1006}
    kept = set(seen["toxicity"])
    assert len(kept & bad) <= 0.05 * len(bad) and 1006 not in kept
    assert len(({r[0] for r in rows} - bad) - kept) <= 5 and {1004, 1005} <= kept
    assert {1000} == set(seen["near_duplicates"]) & {1000, 1001}
    assert 1002 in seen["near_duplicates"] and 1002 not in seen["decontamination"]
    assert set(seen["personal_data"]) == set(seen["decontamination"])
    assert seen["personal_data"][1003] == "write to [EMAIL] or [PHONE] today"
    packed = docs.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("t")).where("n <> t")
    assert packed.count() == 0
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == docs.count()


def test_odd_documents_go_through(spark, tmp_path):
    """Nulls in all columns but the id, repeated rows, extra columns with clashing names; then an empty table."""
    rows = [(1, None, None, None, None), (1, None, None, None, None), (2, "", "en", None, 0), (3, "a plain text of some words " * 3, None, "s", None), (3, "a plain text of some words " * 3, None, "s", None), (4, " \t", "de", "s", 2), (5, "x" * 50_000, "en", "s", 9)]
    labels = [(i, 1, i % 2) for i in range(1, 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({"kept": F.lit("clash"), "score": F.lit(7), "spans": F.lit(1), "ids": F.lit("x"), "n_hit": F.lit(2)})
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, None), (2, "")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for docs in (df, df.limit(0)):
        n = docs.count()
        for name, f in corpus_pipeline.STAGES[1:]:
            docs = f(spark, docs, str(tmp_path))
            if name != "packing":
                assert docs.columns == corpus_pipeline.COLUMNS and docs.count() == n
        assert docs.count() == sum(-(-r.doc_tokens // 2048) > 0 for r in docs.collect())
        assert {r.doc_id for r in docs.collect()} == ({1, 2, 3, 4, 5} if n else set())
        assert all(len(r.ids) == 4 * r.length for r in docs.collect())
