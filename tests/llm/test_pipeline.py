"""The pipeline on a small corpus: every stage's decisions take effect and the rows stay whole."""

import random
from collections import Counter

import numpy as np


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline
    from tests.llm.test_operators import WORD, make_docs

    rng = random.Random(8)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(400)]
    rows, labels = [], []
    for i in range(300):
        t = "\n".join(" ".join(rng.choices(words, k=15)) for _ in range(rng.randint(2, 6)))
        bad = i % 4 == 0
        rows.append((i, " ".join(w + "$$$" for w in t.split()) if bad else t, "en", f"s{i % 3}"))
        labels.append((i, int(not bad), 0))
    rows += [(1000 + i, rows[1][1], "en", "s1") for i in range(5)] + [(2000, None, None, None)]
    make_docs(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns = docs.columns
    seen = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(f"{tmp_path}/stage{k}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/stage{k}")
        seen[name] = (before, docs)
        if k < 4:
            assert docs.columns == columns
    quality = {r["doc_id"] for r in seen["quality_classifier"][1].collect()}
    assert len([i for i in range(300) if i % 4 and i in quality]) > 215 and len([i for i in range(0, 300, 4) if i in quality]) < 5
    copies = {r["doc_id"]: r["text"] for r in seen["line_dedup"][1].where("doc_id >= 1000 and doc_id < 2000").collect()}
    assert set(copies.values()) == {""} or len(rows[1][1].split("\n")) < 3
    ids = [r["doc_id"] for r in seen["simhash_near_dedup"][1].select("doc_id").collect()]
    assert len(ids) == len(set(ids)) and len(set(ids) & set(copies)) <= 1
    size = lambda t: len(WORD.findall(t or ""))
    words_in = sum(size(r["text"]) for r in seen["source_mix"][0].collect())
    words_out = sum(size(r["text"]) for r in seen["source_mix"][1].collect())
    assert abs(words_out / words_in - 1.5) < 0.1
    rows_in = Counter(r["doc_id"] for r in seen["source_mix"][1].collect())
    packed = seen["best_fit_packing"][1].collect()
    assert Counter(r["doc_id"] for r in packed if r["piece"] == 0) == rows_in
    assert max(np.bincount([r["sequence_id"] for r in packed], weights=[r["length"] for r in packed])) <= 2048
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == len(packed)
