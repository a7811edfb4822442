"""Passages of one or two lines with over 50 words, as the pipeline's stage removes them."""

from tests.llm.test_operators import make_docs


def test_long_lines_that_repeat(spark, tmp_path):
    import corpus_pipeline

    line = lambda p, n: " ".join(f"{p}{i}" for i in range(n))
    one, two = line("a", 51), line("b", 30) + "\n\n" + line("c", 21)
    rows = [(1, one), (2, "x\n" + one + "\ny"), (3, two), (4, two + "\nown"), (5, line("d", 50)), (6, line("d", 50)), (7, one + "\n" + one), (8, None), (9, "")]
    docs = make_docs(spark, [(i, t, "en", "a") for i, t in rows])
    out = {r["doc_id"]: r["text"] for r in dict(corpus_pipeline.STAGES)["line_dedup"](spark, docs, str(tmp_path)).collect()}
    assert out == dict(rows) | {2: "x\ny", 4: "own", 7: ""}
