"""Near copies of the pipeline's stage: every pair of 0.8 or more in common is joined, found against brute force."""

import random

from pyspark.sql import functions as F

from tests.llm.test_operators import WORD, make_docs


def shingles(text):
    w = WORD.findall((text or "").lower())
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set())


def kept(rows):
    sets = [(i, t, shingles(t)) for i, t in sorted(set(rows), key=lambda r: r[0])]
    near = lambda a, b: a == b or len(a & b) >= 0.8 * len(a | b)
    groups = []
    for i, t, s in sets:
        joined = [g for g in groups if any(near(s, x) for _, _, x in g)]
        groups = [g for g in groups if g not in joined] + [[(i, t, s), *(x for g in joined for x in g)]]
    return {min(g, key=lambda x: x[0])[0] for g in groups}


def test_stage_joins_near_copies(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(400)]
    text = lambda n: rng.choices(words, k=n)
    rows, planted = [], set()
    for i in range(40):
        base = text(rng.randint(40, 300))
        rows.append((i, " ".join(base)))
        for c in range(4):
            copy = list(base)
            for at in rng.sample(range(len(copy)), rng.randint(1, 8)):
                copy[at] = "changed" + str(rng.random())
            rows.append((1000 + 10 * i + c, " ".join(copy)))
            a, b = shingles(rows[-1][1]), shingles(" ".join(base))
            planted |= {1000 + 10 * i + c} if len(a & b) >= 0.8 * len(a | b) else set()
    many = text(150)  # one large group; each member differs from each other
    rows += [(3000 + i, " ".join(many[: i % 150] + [f"w{i}"] + many[i % 150 :])) for i in range(300)]
    rows += [(5000, None), (5001, ""), (5002, "one two"), (5003, "One two"), (5004, "one two three")]
    docs = make_docs(spark, [(i, t, "en", "a") for i, t in rows])
    out = dict(corpus_pipeline.STAGES)["simhash_near_dedup"](spark, docs, str(tmp_path))
    assert out.columns == docs.columns
    got = [r["doc_id"] for r in out.collect()]
    assert len(got) == len(set(got)) and set(got) == kept(rows)
    assert len(planted) > 50 and not planted & set(got)


def test_repeated_and_null_ids(spark):
    from tessella.llm.near_dedup import near_dedup

    docs = make_docs(spark, [(1, "a b c d e f", "en", "a"), (1, "a b c d e f", "en", "a"), (1, "u v w x y z", "en", "a"), (None, "U v w x y z", "en", "a"), (None, "p q r s t", "en", "a"), (None, "k l m n o", "en", "a")])
    got = sorted((str(r["doc_id"]), r["text"]) for r in near_dedup(docs).collect())
    assert got == [("1", "a b c d e f"), ("1", "u v w x y z"), ("None", "k l m n o"), ("None", "p q r s t")]
    assert near_dedup(docs.limit(0)).count() == 0


def test_groups_that_share_a_passage(spark):
    """A large group, smaller groups and single documents meet at one passage; only near copies are joined."""
    from tessella.llm.near_dedup import near_dedup

    rng = random.Random(9)
    word = lambda: "w" + str(rng.randrange(10**9))
    passage = [word() for _ in range(40)]
    rows, n = [], 0
    for members in (60, 9, 9, 4, 2, 2, 1, 1, 1):
        base = passage + [word() for _ in range(100)]
        for m in range(members):
            copy = list(base)
            for at in rng.sample(range(40, 140), rng.randint(0, 3)):
                copy[at] = word()
            rows.append(((n * 37) % 1009, " ".join(copy)))
            n += 1
    docs = make_docs(spark, [(i, t, "en", "a") for i, t in rows])
    assert {r["doc_id"] for r in near_dedup(docs).collect()} == kept(rows)


def test_sets_of_one_node_are_told_apart(spark):
    from tessella.llm.near_dedup import told_apart

    rows = [(1, 77, 5), (2, 77, 5), (3, 77, 6), (4, 77, 9), (5, 77, 9), (6, 8, 1), (7, 8, 1)]
    got = {r["doc_id"]: r["node"] for r in told_apart(spark.createDataFrame(rows, "doc_id long, node long, second long")).collect()}
    assert got[1] == got[2] == 77 and got[4] == got[5] and len({got[1], got[3], got[4], got[6]}) == 4 and got[6] == got[7] == 8
    assert told_apart(spark.createDataFrame(rows[:2], "doc_id long, node long, second long")).columns == ["doc_id", "node"]


def test_counts_of_all_rows(spark, monkeypatch):
    """Every row counts, over more tasks than are added at a time."""
    import numpy as np

    from tessella.llm import near_dedup as N

    monkeypatch.setattr(N, "FAN", 3)
    rng = random.Random(2)
    texts = [" ".join(rng.choices("abcdefgh", k=rng.randint(0, 40))) for _ in range(300)] + [None, ""]
    docs = make_docs(spark, [(i, t, "en", "a") for i, t in enumerate(texts)]).repartition(11)
    want = np.zeros(1 << 17)
    for t in texts:
        np.add.at(want, N.place(N.shingle_hashes(t), 17), 1)
    assert (N.place_counts(docs, 5, 17) == (8 * np.log2(1 + want)).astype(np.uint8)).all() and want.max() > 1
    assert (N.power_of(0), N.power_of(50_000), N.power_of(10**12)) == (18, 20, 24)


def test_a_passage_of_one_document_in_a_hundred(spark):
    """A common passage is no rare shingle, however many rows there are: pairs met stay few."""
    from tessella.llm import near_dedup as N

    rng = random.Random(6)
    word = lambda: "w" + str(rng.randrange(10**9))
    passage = [word() for _ in range(30)]
    rows = [(i, " ".join((passage if i % 100 < 10 else []) + [word() for _ in range(40)])) for i in range(1000)]
    rows += [(2000 + i, t + " more") for i, t in rows[:20]]
    docs = make_docs(spark, [(i, t, "en", "a") for i, t in rows])
    prints = N.told_apart(N.shingle_prints(docs, 5, 0.8)).cache()
    assert {tuple(sorted(x)) for x in prints.groupBy("node").count().where("count > 1").select("node", "count").collect()} == set()
    tokens = prints.selectExpr("explode(rare) AS t").groupBy("t").count()
    assert tokens.agg(F.max("count")).first()[0] <= 2  # of 100 documents with the passage none has it among its rare shingles
    assert {r["doc_id"] for r in N.near_dedup(docs).collect()} == set(range(1000))
