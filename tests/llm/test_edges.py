"""Corpus operators against plain Python, and every stage on odd tables: nulls, ties, long texts, clashing columns, nothing at all."""

import math
import random
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from pyspark.sql import functions as F

from tests.llm.test_operators import WORD, make_docs


# ---------------------------------------------------------------- 1 and 2


def test_certified_cutoffs_against_brute_force(spark):
    from tessella.llm.quality_rules import CUTOFFS, quality_rules

    rng = random.Random(12)
    rows, labels = [], []
    for i in range(3000):
        lang = rng.choice(["en", "en", "de", None])
        words = ["".join(rng.choices("abcdefghij", k=rng.randint(3, 9))) + ("$" if rng.random() < (0.3 if i % 9 == 0 else 0.01) else "") for _ in range(24)]
        text = "\n".join(" ".join(words[k : k + 6]) for k in range(0, 24, 6))
        rows.append((i, text + ("\n" + " ".join(words[:6]) if rng.random() < (0.5 if i % 9 == 0 else 0.002) else ""), lang, "a"))
        labels.append((i, 0 if i % 9 == 0 else 1))
    got = {r["doc_id"]: r for r in quality_rules(make_docs(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int")).collect()}

    def values(r, text):
        n, lines = max(1, r["n_words"]), [x for x in text.split("\n") if WORD.search(x)]
        return {"symbol_share": r["n_symbols"] / n, "dup_line_share": r["n_dup_lines"] / max(1, len(lines)), "repeat_share": r["n_repeat_words"] / n, "mean_word": r["word_chars"] / n}

    seen = {i: (lang, values(got[i], text)) for i, text, lang, _ in rows}
    good = [i for i, q in labels if q and not got[i]["base_failed"]]
    langs = {seen[i][0] for i in good}
    breaks = lambda v, t: [r for r, cs in CUTOFFS.items() if v[r] > cs[min(t, len(cs) - 1)]]
    limit = {}
    for lang in langs:
        mine = [seen[i][1] for i in good if seen[i][0] == lang]
        for t in range(max(map(len, CUTOFFS.values()))):
            k, n, p = sum(bool(breaks(v, t)) for v in mine), len(mine), 0.04
            tail = sum(math.comb(n, j) * p**j * (1 - p) ** (n - j) for j in range(k + 1)) if k < n * p else 1.0
            if tail > 0.05 / len(langs):
                break
            limit[lang] = t
    assert len(limit) == 3
    broken = {i: ",".join(breaks(v, limit[lang]) if lang in limit else []) for i, (lang, v) in seen.items()}
    assert broken == {i: r["broken_rules"] for i, r in got.items()} and any(broken.values())
    assert all(r["kept"] == (not r["base_failed"] and not broken[i]) for i, r in got.items())


def test_quality_fit_against_plain_ridge(spark):
    from tessella.llm import quality_classifier as Q

    rng = np.random.default_rng(3)
    x = rng.normal(size=(500, Q.N_STATS))
    y = (x[:, 0] + 0.5 * x[:, 1] ** 2 + rng.normal(size=500) * 0.3 > 0.3).astype(float)
    stats = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "doc_id long, x array<double>").repartition(40)
    labels = spark.createDataFrame([(i, int(v)) for i, v in enumerate(y)], "doc_id long, label int")
    model = Q.fit_quality(stats, labels, width=32)
    fold = np.array([zlib.crc32(str(i).encode()) % 5 for i in range(500)])
    fit, hold = np.isin(fold, [1, 2, 3]), fold == 4
    assert np.allclose(model.mean, x[fit].mean(0)) and np.allclose(model.scale, x[fit].std(0))
    z = (x - x[fit].mean(0)) / x[fit].std(0)
    wide = np.hstack([np.ones((500, 1)), z, np.sqrt(2 / 32) * np.cos(z @ model.w + model.b)])
    lean = 1e-3 * fit.sum() / wide.shape[1] * np.eye(wide.shape[1])
    lean[0, 0] = 0
    beta = np.linalg.solve(wide[fit].T @ wide[fit] + lean + 1e-9 * np.eye(len(lean)), wide[fit].T @ y[fit])
    raw = np.clip(wide @ beta, 0, 1)
    assert np.allclose(model.raw(x), raw, atol=1e-6)
    # isotonic levels: pooled neighbours' means, leant by half a row
    bins = np.minimum((model.raw(x) * 1000).astype(int), 999)
    groups = [[np.array([y[hold & (bins == b)].sum(), (hold & (bins == b)).sum()], float), b] for b in sorted(set(bins[hold]))]
    k = 0
    while k + 1 < len(groups):
        (a, n), (c, m) = groups[k][0], groups[k + 1][0]
        if a / n >= c / m:
            groups[k : k + 2] = [[groups[k][0] + groups[k + 1][0], groups[k][1]]]
            k = max(0, k - 1)
        else:
            k += 1
    prior = (y[hold].sum() + 1) / (hold.sum() + 2)
    for (a, n), b in groups:
        assert abs(model.levels[b] - (a + 0.5 * prior) / (n + 0.5)) < 1e-9
    assert (np.diff(model.levels) >= 0).all()


# ---------------------------------------------------------------- 4


def plain_features(text, codes, T):
    words = [w for w in WORD.findall(text)]
    n = len(words)
    if not n:
        return [0.0] * T.N_FEATURES
    code = [codes[w] for w in words]
    bad, you = [i for i, c in enumerate(code) if c & 19], [i for i, c in enumerate(code) if c & 4]
    gaps = [min([abs(i - j) for j in you], default=1000) for i in bad]
    lexicon, insult, leet = (sum(bool(c & k) for c in code) for k in (1, 2, 16))
    stops, signs = (sum(text.count(c) for c in s) for s in ("!?", "*#$@"))
    return [lexicon / n, math.log1p(lexicon), insult / n, math.log1p(insult), len({words[i].lower().strip(T.TRIM) for i in bad}), sum(g <= T.NEAR for g in gaps) / n, math.log1p(min([1000, *gaps])), len(you) / n, sum(bool(c & 32) for c in code) / n, stops / len(text), signs / len(text), sum(bool(c & 8) for c in code) / n, leet / n, math.log1p(n)]


def test_toxic_features_against_plain_python():
    from tessella.llm import toxicity as T

    rng = random.Random(7)
    pieces = ["you", "YOUR", "idiot", "Idiot!", "1d10t", "zorg", "zorgling", "plain", "word", "du", "St*pid", "CAPS", "é!", "?", "$$$", "a-b", "x"]
    texts = ["", "  ", "idiot", " you  idiot\n\tyou "] + ["".join(rng.choice(pieces) + rng.choice([" ", "\n", "  "]) for _ in range(rng.randint(0, 60))) for _ in range(200)]
    texts += [" ".join(f"idiot{i} zorg{i}" for i in range(12_000))]  # all of a very long text counts
    lexicon = {"zorg": 2.0, "zorg^": 1.0, "idiot^": 1.5}
    got = T.toxic_features(pa.array(texts), T.WordCodes(lexicon))
    want = np.array([plain_features(t, T.WordCodes(lexicon), T) for t in texts])
    assert np.allclose(got, want) and got[-1, 4] == 24_000
    assert T.toxic_features(pa.array(["x y", "you idiot", "z"]).slice(1), T.WordCodes({})).shape == (2, T.N_FEATURES)


def test_toxicity_of_nothing(spark):
    from tessella.llm.toxicity import toxicity_scores

    docs = make_docs(spark, [(1, "you idiot", "en", "a"), (None, None, None, None)])
    labels = spark.createDataFrame([(1, 1), (2, None)], "doc_id long, label int")
    assert toxicity_scores(docs.limit(0), labels).count() == 0
    assert len(toxicity_scores(docs, labels.limit(0)).collect()) == 2


# ---------------------------------------------------------------- 3 and 8


def test_very_long_urls(spark):
    from tessella.llm.url_filters import url_filter

    rows = [(1, "http://" + "a." * 20_000 + "net/" + "p/" * 50_000), (None, "http://b.net/en/"), (2, None)]
    rules = spark.createDataFrame([("net", "/", "block"), ("b.net", "/en", "allow"), ("net", "/" + "p/" * 50, "allow")], "host string, path string, verdict string")
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("stack", F.lit(1)).withColumn("host", F.lit("x"))
    got = {r["page_id"]: (r["rule"] and r["rule"][:9], r["verdict"]) for r in url_filter(pages, rules).collect()}
    assert got == {1: ("net/p/p/p", "allow"), None: ("b.net/en", "allow"), 2: (None, "allow")}


def test_linked_parts_against_all_pairs():
    from tessella.llm import secret_scan as S

    rng = random.Random(11)
    role = {"access": 0, "identifier": 0, "assign": 1, "hex": 1, "secret": 1, "endpoint": 2}
    for _ in range(400):
        text = "".join(rng.choices("=: /x", k=400))
        spans = []
        for _ in range(rng.randint(1, 14)):
            s = rng.randint(1, 380)
            spans.append((rng.choice(list(role)), s, s + rng.randint(1, rng.choice([5, 20, 200]))))
        spans = list(dict.fromkeys((k, s, min(e, 400)) for k, s, e in spans if s < 400))
        base, weak = [x for x in spans if x[0] in S.KINDS[:3]], [x for x in spans if x[0] not in S.KINDS[:3]]
        scope = rng.choice([0, 10, 60])
        want = []
        for k, s, e in weak:
            if any(a < e and s < b for _, a, b in base):
                continue
            for k2, a, b in spans:
                r = role[k2]
                if (a, b) == (s, e) or r not in {"secret": (0, 2), "identifier": (1,), "endpoint": (1,)}[k] or a > e + scope or b < s - scope:
                    continue
                inside = r == 2 and not (text[s - 1] == "=" or text[s - 1] == ":" and text[s : s + 1] != "/") and a < e and s < b
                if not inside:
                    want.append((k, s, e))
                    break
        assert S.linked_parts(base, weak, scope, text) == want


@pytest.mark.parametrize("unit", ["a", "a.", "A1b-", "user", "jdbc:", "0f", "AKIA", "token=", "https://x", "x.amazonaws.com ", "id=ab1 ", "'\"", "="])
def test_a_megabyte_takes_under_a_second_or_so(unit):
    from tessella.llm.secret_scan import scan_text

    text = unit * (1_000_000 // len(unit)) + " :// amazonaws"
    began = time.process_time()
    scan_text(text)
    assert time.process_time() - began < 4


# ---------------------------------------------------------------- stages


def odd_docs(spark):
    long = "\n".join(f"line {i} of {i * i} words {i % 7}" for i in range(4000))
    rows = [(1, long, "en", "a"), (2, long, "en", "a"), (3, "a b c d e f g", "en", "b"), (5, "a b c d e f g", "en", "b"), (5, "q w e r t y u", "de", None), (5, "q w e r t y u", "de", None)]
    rows += [(None, "lone text of no id", "en", "a"), (None, None, None, None), (7, None, "en", "a"), (8, "", "en", "a"), (9, " \n\t", None, "b")]
    docs = make_docs(spark, rows)
    for name in ("n_lines", "n_removed", "copies", "_id", "_gone", "_tie", "_text", "tie", "gone", "hash", "h1", "spans", "lines", "new", "turns", "size", "m", "words", "g", "x", "_0", "_1", "source_size"):
        docs = docs.withColumn(name, F.concat(F.lit(f"{name} of "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))))
    return docs


def test_every_stage_on_odd_tables(spark, tmp_path):
    import corpus_pipeline

    docs = odd_docs(spark)
    spark.createDataFrame([(i, i % 2, 0) for i in range(20)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        rows = out.collect()
        if name != "best_fit_packing":
            assert out.columns == docs.columns, name
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
        kept = Counter((r["doc_id"], r["text"]) for r in rows) if name != "best_fit_packing" else None
        if name == "line_dedup":
            assert len(rows) == docs.count() and kept[(2, "")] == 1 and kept[(5, "q w e r t y u")] == 2
        if name == "simhash_near_dedup":
            assert {i for i, t in kept if t and t.startswith("a b c")} == {3} and kept[(5, "q w e r t y u")] == 1 and kept[(None, "lone text of no id")] == 1
            assert sum(n for (_, t), n in kept.items() if not (t or "").strip()) == 1 and max(kept.values()) == 1
            assert all(r["copies"] == f"copies of {'none' if r['doc_id'] is None else r['doc_id']}" for r in rows)
        if name == "source_mix":
            assert (None, "lone text of no id") in kept and not [t for _, t in kept if not (t or "").strip()] and max(kept.values()) <= 4
        if name == "best_fit_packing":
            assert Counter(r["doc_id"] for r in rows if r["piece"] == 0) == Counter(r["doc_id"] for r in docs.collect())


def test_queries_name_no_clashing_column(spark):
    from tessella.llm.line_dedup import line_dedup
    from tessella.llm.mixing import fair_mix, take_mix
    from tessella.llm.simhash_dedup import simhash_classes, simhash_dedup

    docs = odd_docs(spark)
    out = line_dedup(docs)
    assert Counter(out.columns) == Counter(docs.columns) and {type(r["n_lines"]) for r in out.collect()} == {int}
    taken, rows = fair_mix(docs).groupBy().sum("copies").first()[0], take_mix(docs).count()
    assert taken == rows > 0
    kept = Counter((r["doc_id"], r["text"]) for r in simhash_dedup(docs).collect())
    assert {(1, docs.first()["text"]), (3, "a b c d e f g"), (5, "q w e r t y u"), (None, "lone text of no id")} <= set(kept) and max(kept.values()) == 1
    found = {(r["doc_id"], r["component_id"]) for r in simhash_classes(docs).collect()}
    assert {(5, 3), (5, 5), (None, 7), (9, 7), (None, None)} <= found
    assert simhash_dedup(docs.limit(0)).count() == 0
