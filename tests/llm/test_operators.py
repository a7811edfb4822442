"""Each operator on small fixtures: brute force, nulls, empty and long texts, ties, repeats, extra columns, empty tables."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from pyspark.sql import functions as F

from tessella.llm import packing, secret_scan, simhash_dedup
from tessella.llm.common import pool_adjacent
from tessella.llm.embedding_dedup import embedding_classes
from tessella.llm.graph import components
from tessella.llm.line_dedup import line_dedup
from tessella.llm.mixing import fair_mix
from tessella.llm.quality_classifier import keep_good, quality_scores
from tessella.llm.quality_rules import binomial_cdf, document_stats, quality_rules
from tessella.llm.toxicity import toxicity_scores
from tessella.llm.url_filters import url_filter

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def make_docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, src, len(t or "")) for i, t, lang, src in rows], DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(300)]
    lines = lambda n: "\n".join(" ".join(rng.choices(words, k=12)) for _ in range(n))
    passage = lines(4)
    rows = [(i, lines(rng.randint(1, 8)), rng.choice(["en", "de", None]), rng.choice(["a", "b", "b", "b", None])) for i in range(80)]
    rows += [(100 + i, lines(2) + "\n" + passage + "\n" + lines(1), "en", "a") for i in range(4)]
    rows += [(200, None, None, None), (201, "", "en", "a"), (202, " \n\t ", "en", "b"), (203, lines(1500), "en", "b")]
    rows += [(204, rows[3][1], "en", "a"), (205, rows[3][1], "en", "a"), (206, "x\n\ny\nz\nx\n\ny\nz", "en", "c"), (206, "x\n\ny\nz\nx\n\ny\nz", "en", "c")]
    return make_docs(spark, rows).withColumn("hash", F.lit("clash")).withColumn("words", F.lit(1)).withColumn("rep", F.lit(2))


@pytest.fixture(scope="module")
def texts(docs):
    return [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]


def test_pool_adjacent_is_monotone_and_keeps_the_mean():
    m, w = np.array([0.1, 0.5, 0.3, 0.9, 0.2]), np.array([1.0, 2, 2, 1, 1])
    f = pool_adjacent(m, w)
    assert (np.diff(f) >= 0).all() and abs((f * w).sum() - (m * w).sum()) < 1e-9


def test_components_of_long_chain_and_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 140)] + [(7, 7), (3, 2)]
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(found[i] == 0 for i in range(41)) and all(found[x] == 100 for x in range(100, 140))
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---------------------------------------------------------------- 1 quality rules


def brute_stats(text):
    w = WORD.findall(text or "")
    c = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
    cover = {p for k in range(len(w) - 7) if c[tuple(w[k : k + 8])] > 1 for p in range(k, k + 8)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in text or ""), len(lines) - len(set(lines)), len(cover)


def test_statistics_against_brute_force(docs, texts):
    got = Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in document_stats(docs).collect())
    assert got == Counter((i, *brute_stats(t)) for i, t in texts)


def test_binomial_tail_is_exact(spark):
    from math import comb

    cases = [(0, 100), (1, 100), (3, 700), (7, 2000), (40, 5000), (90, 100)]
    df = spark.createDataFrame(cases, "k long, n long").select("k", "n", binomial_cdf(F.col("k"), F.col("n"), 0.01).alias("p"))
    for r in df.collect():
        want = sum(comb(r["n"], j) * 0.01**j * 0.99 ** (r["n"] - j) for j in range(r["k"] + 1)) if r["k"] < 0.01 * r["n"] else 1.0
        assert abs(r["p"] - want) < 1e-9 * max(want, 1e-6)


def test_certified_cutoff_rejects_symbols_and_keeps_good(spark):
    rng = random.Random(1)
    good = [" ".join("".join(rng.choices("abcde", k=5)) for _ in range(30)) for _ in range(1200)]
    rows = [(i, t, "en", "a") for i, t in enumerate(good)] + [(5000, " ".join(f"w{i}$$$" for i in range(40)), "en", "a"), (5001, " ".join(f"w{i}$$$" for i in range(40)), "de", "a")]
    labels = spark.createDataFrame([(i, 1) for i in range(1200)] + [(5000, 0), (5001, None)], "doc_id long, quality int")
    out = {r["doc_id"]: r for r in quality_rules(make_docs(spark, rows), labels).collect()}
    assert all(out[i]["kept"] for i in range(1200))
    assert not out[5000]["kept"] and "symbol_share" in out[5000]["broken_rules"]
    assert out[5001]["kept"]  # no labels in its stratum: only base rules


def test_quality_rules_edge_cases(spark, docs):
    none = spark.createDataFrame([], "doc_id long, quality int")
    out = quality_rules(docs, none)
    assert out.count() == docs.count() and not [r for r in out.where("doc_id in (200, 201, 202)").collect() if not r["base_failed"]]
    assert quality_rules(docs.limit(0), none).count() == 0


# ---------------------------------------------------------------- 2 and 4 classifiers


@pytest.fixture(scope="module")
def marked(spark):
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(400)]
    rows, labels = [], []
    for i in range(600):
        text = " ".join(rng.choices(words, k=60))
        bad, toxic = rng.random() < 0.3, rng.random() < 0.3
        if bad:
            text = " ".join(w + "$$$" for w in text.split())
        if toxic:
            text = " ".join(x if rng.random() > 0.1 else "idiot" for x in text.split()) + " you idiot zorgling"
        rows.append((i, text, "en", "a"))
        labels.append((i, int(not bad), int(toxic)))
    rows += [(9000, None, None, None), (9001, "", "en", "a"), (9002, rows[0][1] * 200, "en", "a"), (0, rows[0][1], "en", "a")]
    return make_docs(spark, rows).withColumn("x", F.lit(1)).withColumn("score", F.lit("s")), spark.createDataFrame(labels + [(9001, None, None)], "doc_id long, quality int, toxic int")


def held_out_accuracy(scores, labels, column, keep, cut):
    right = [int(r["score"] >= cut) == r[column] for r in scores.join(labels, "doc_id").where(f"{column} is not null").collect() if keep(r["doc_id"])]
    return sum(right) / len(right)


def test_quality_classifier(spark, marked):
    docs, labels = marked
    lab = labels.select("doc_id", F.col("quality").alias("label"))
    scores = quality_scores(docs, lab)
    rows = scores.collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert held_out_accuracy(scores, labels, "quality", lambda i: zlib.crc32(str(i).encode()) % 5 == 0, 0.3) > 0.95
    assert len({r["score"] for r in rows if r["doc_id"] == 0}) == 1
    kept = keep_good(docs, lab)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()
    assert quality_scores(docs.limit(0), lab).count() == 0
    assert {r["score"] for r in quality_scores(docs, lab.limit(0)).collect()} == {0.5}


def test_toxicity(spark, marked):
    docs, labels = marked
    lab = labels.select("doc_id", F.col("toxic").alias("label"))
    scores = toxicity_scores(docs, lab, trees=5)
    rows = scores.collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert held_out_accuracy(scores, labels, "toxic", lambda i: zlib.crc32(str(i).encode()) % 3 == 1, 0.7) > 0.95
    assert {r["score"] for r in toxicity_scores(docs, lab.limit(0)).collect()} == {0.5}


# ---------------------------------------------------------------- 3 url filters


def test_url_filter_against_brute_force(spark):
    rng = random.Random(2)
    hosts = ["net", "a.net", "b.a.net", "example.net", "www.example.net", "org", "x.org", "xnet", "", "A.NET", "fr.x.org", "net.a"]
    paths = ["", "/", "/en/", "/en/x", "/de", "/de/1", "/fr/é", "/en"]
    urls = [f"http://{h}{p}{q}" for h in hosts for p in paths for q in ("", "?a=://b", "#t")] + [None, "", "no scheme", "://", "http://a.net/\n/x"]
    rows = [(i, u, "x") for i, u in enumerate(urls)] + [(0, urls[0], "x")] + [(10_000 + i, "http://hot.net/en/1", "x") for i in range(500)]
    pages = spark.createDataFrame(rows, "page_id long, url string, rule string")
    rules = [("net", "/", "block"), ("a.net", "/en", "allow"), ("a.net", "/en/x", "block"), ("a.net", "/en/x", "allow"), ("b.a.net", "/", "allow"), ("org", "", "block"), ("x.org", "/d", "allow"), (None, "/", "block"), ("net", None, "block")]
    got = {(r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter(pages, spark.createDataFrame(rules, "host string, path string, verdict string")).collect()}
    want = set()
    for i, u, _ in rows:
        h = p = ""
        if u and "://" in u:
            m = re.match(r"([^/?#]*)([^?#]*)", u.split("://", 1)[1])
            h, p = re.sub("[A-Z]", lambda c: c[0].lower(), m[1]), m[2]
        fits = [(len(a) + len(b), v, a + b) for a, b, v in rules if a is not None and b is not None and (h == a or h.endswith("." + a)) and p.startswith(b)]
        best = max(fits, default=None)
        want.add((i, h, p, best[2] if best else None, best[1] if best else "allow"))
    assert got == want
    assert url_filter(pages.limit(0), spark.createDataFrame(rules, "host string, path string, verdict string")).count() == 0
    assert url_filter(pages, spark.createDataFrame([], "host string, path string, verdict string")).where("verdict <> 'allow'").count() == 0
    assert rng


# ---------------------------------------------------------------- 5 mixing


def test_mix_meets_targets(docs, texts):
    rows = fair_mix(docs).collect()
    assert len(rows) == len(texts) and all(r["taken"] <= 2 * r["size"] for r in rows)
    size, taken, target = Counter(), Counter(), {}
    for r in rows:
        size[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        target[r["source"]] = r["target"]
    weight = dict(zip(sorted((s for s in size if s is not None)) + [None], itertools.cycle([3, 1, 2])))
    left, full = 1.5 * sum(size.values()), set()
    while True:  # reshare by rounds
        level = left / sum(weight[s] for s in size if s not in full) if len(full) < len(size) else 0
        over = {s for s in size if s not in full and level * weight[s] > 2 * size[s]}
        if not over:
            break
        full |= over
        left -= sum(2 * size[s] for s in over)
    for s in size:
        want = 2 * size[s] if s in full else level * weight[s]
        assert abs(target[s] - want) < 1e-6 * max(1, want)
    assert sum(taken.values()) <= sum(target.values()) + 1e-6
    again = fair_mix(docs.repartition(3)).collect()
    assert Counter((r["doc_id"], r["taken"]) for r in rows) == Counter((r["doc_id"], r["taken"]) for r in again)
    assert fair_mix(docs.limit(0)).count() == 0


# ---------------------------------------------------------------- 6 embeddings


def brute_classes(ids, rows, cosine=0.95):
    fit = [r is not None and len(r) > 0 and all(x is not None and np.isfinite(x) for x in r) and any(r) for r in rows]
    parent, links = {i: i for i in ids}, dict.fromkeys(ids, 0)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    def unit(r):
        u = np.array(r, float) / np.abs(r).max()
        return u / np.linalg.norm(u)

    for n in {len(r) for r, f in zip(rows, fit) if f}:
        on = [i for i, f in enumerate(fit) if f and len(rows[i]) == n]
        u = np.array([unit(rows[i]) for i in on])
        near = u @ u.T >= cosine - 1e-15
        for a, b in zip(*np.nonzero(near)):
            if a != b:
                links[ids[on[a]]] += 1
                x, y = root(ids[on[a]]), root(ids[on[b]])
                parent[max(x, y)] = min(x, y)
    return {i: (links[i], root(i), root(i) == i) for i in ids}


@pytest.mark.parametrize("grid", [None, 2, 3])
def test_embeddings_against_brute_force(spark, grid):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(60, 24))
    rows = [b.tolist() for b in base] + [(base[i % 5] * 3).tolist() for i in range(20)] + [(base[i % 7] + rng.normal(size=24) * s).tolist() for i in range(60) for s in (0.05, 0.2, 0.3)]
    rows += [base[0].tolist()] * 30 + [None, [], [0.0] * 24, [float("nan")] * 24, [None] + [1.0] * 23, [1.0, 2.0], [float("inf")] + [1.0] * 23]
    # other lengths, and magnitudes whose squares overflow or vanish
    short = rng.normal(size=(12, 6))
    rows += [(short[i % 12] + rng.normal(size=6) * 0.05).tolist() for i in range(40)] + [[2.0], [3.0], [-1.0], [1.0, 2.01]]
    rows += [(base[i] * f).tolist() for i in range(4) for f in (1e200, 1e-200, 1e-170)] + [[1e-170, 1e-170], [1e-170, -1e-170], [5e-324, 0.0]]
    df = spark.createDataFrame([(i, r, 0, "x", "y") for i, r in enumerate(rows)], "vec_id long, embedding array<double>, label int, rep string, n string")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_classes(df, grid=grid).collect()}
    assert got == brute_classes(list(range(len(rows))), rows)
    assert embedding_classes(df.limit(0)).count() == 0


def test_cells_are_cut_into_tiles(spark, monkeypatch):
    from tessella.llm import embedding_dedup as E

    monkeypatch.setattr(E, "TILE", 16)
    rng = np.random.default_rng(1)
    centre = rng.normal(size=16)
    rows = [(centre + rng.normal(size=16) * 0.12).tolist() for _ in range(150)] + [rng.normal(size=16).tolist() for _ in range(50)]
    df = spark.createDataFrame(list(enumerate(rows)), "vec_id long, embedding array<double>")
    assert {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in embedding_classes(df).collect()} == brute_classes(list(range(len(rows))), rows)
    # a null id: a row of its own, whatever it equals
    odd = spark.createDataFrame([(None, rows[0]), (7, rows[0]), (7, rows[0])], "vec_id long, embedding array<double>")
    assert sorted(map(str, embedding_classes(odd).collect())) == sorted(map(str, [r for r in spark.createDataFrame([(None, 0, None, True), (7, 1, 7, True), (7, 1, 7, True)], "vec_id long, n_links long, component_id long, kept boolean").collect()]))


# ---------------------------------------------------------------- 7 simhash


def brute_print(text):
    import xxhash

    w = WORD.findall(re.sub("[A-Z]", lambda c: c[0].lower(), text or ""))
    grams = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints_against_brute_force(texts):
    for _, t in texts:
        assert simhash_dedup.fingerprint(t) == brute_print(t)


@pytest.mark.parametrize("most", [1, 2, 3])
def test_pigeonring_loses_no_pair(spark, most):
    rng = random.Random(most)
    prints = {0}
    for _ in range(60):
        x = rng.getrandbits(64)
        prints.add(x)
        for _ in range(6):
            y = x
            for b in rng.sample(range(64), rng.randint(1, 5)):
                y ^= 1 << b
            prints.add(y)
    prints = sorted(prints)
    df = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p, i) for i, p in enumerate(prints)], "fp long, rep long")
    got = {tuple(sorted((r["a"], r["b"]))) for r in simhash_dedup.near_pairs(df, most).collect()}
    want = {(i, j) for i in range(len(prints)) for j in range(i + 1, len(prints)) if (prints[i] ^ prints[j]).bit_count() <= most}
    assert got == want and want


def test_simhash_dedup_keeps_one_of_each_group(docs):
    kept = simhash_dedup.simhash_dedup(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.select("doc_id").collect()]
    assert len(ids) == len(set(ids)) and 3 in ids and 204 not in ids and 205 not in ids and {200, 201, 202} & set(ids) == {200}
    assert simhash_dedup.simhash_dedup(docs.limit(0)).count() == 0


# ---------------------------------------------------------------- 8 secrets


def test_base_spans_against_the_plain_patterns():
    rng = random.Random(9)
    pieces = ["password", "Token", "api_key", "apikey", "SECRET", "=", ":", " ", '"', "'", "AKIA", "ABCD1234", "abcdef0123456789", "deadbeef", "é", "\n", "x", "==", "ſecret", "Key"]
    plain = [("assign", re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)), ("access", re.compile("AKIA[A-Z0-9]+")), ("hex", re.compile("[0-9a-f]+"))]
    for _ in range(3000):
        t = "".join(rng.choices(pieces, k=rng.randint(1, 25)))
        want = [(k, m.start(), m.end()) for k, p in plain for m in p.finditer(t) if (len(m[2]) >= 6 if k == "assign" else len(m[0]) >= (20 if k == "access" else 24))]
        assert secret_scan.base_spans(t) == want, t


def test_weak_parts_need_their_complement(spark):
    key = "wJalrXUtnFEMIK7MDENGbPxRfiCYEXAMPLEKEY12"
    alone, both = f"the value {key} here", f"client_id: app.one and then {key} at https://svc.example.org/x"
    far = f"client_id: app.one {'z ' * 400} {key}"
    assert secret_scan.scan_text(alone)[1] == [] and secret_scan.scan_text(far)[1] == []
    assert {k for k, _, _ in secret_scan.scan_text(both)[1]} == {"identifier", "secret", "endpoint"}
    df = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, both, 0), (3, both, 0)], "doc_id long, text string, spans int")
    rows = secret_scan.secret_scan(df).collect()
    assert len(rows) == 4 and rows[0]["base_sha256"] == hashlib.sha256(b"").hexdigest() and rows[0]["spans"] == ""
    assert secret_scan.secret_scan(df.limit(0)).count() == 0


# ---------------------------------------------------------------- 9 packing


def test_plan_uses_every_length_as_often_as_it_occurs():
    rng = random.Random(6)
    for most in (16, 64, 2048):
        have = Counter(min(most, int(rng.expovariate(1 / (most / 4))) + 1) for _ in range(3000))
        have[most] += 500
        plan = packing.plan_sequences(dict(have), most)
        used = Counter()
        for p, n in plan:
            assert sum(p) <= most and n > 0
            for v in p:
                used[v] += n
        assert used == have
        assert sum(n for _, n in plan) <= 1.02 * sum(k * v for k, v in have.items()) / most + 2


def test_pieces_round_trip_and_fit(docs, texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = [tuple(r) for r in packing.pack(docs).collect()]
    want = Counter()
    for i, t in texts:
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        want.update((i, k // 2048, k, len(ids[k : k + 2048]), zlib.crc32(ids[k : k + 2048].tobytes())) for k in range(0, len(ids), 2048))
    assert Counter(r[:5] for r in rows) == want
    for _, g in itertools.groupby(sorted(rows, key=lambda r: (r[5], r[6])), key=lambda r: r[5]):
        end = 0
        for r in g:
            assert r[6] == end
            end += r[3]
        assert end <= 2048
    assert packing.pack(docs.limit(0)).count() == 0


def test_text_ids_equal_the_whole_tokenizer():
    import pyarrow as pa
    import public_tokenizers

    odd = ["don't STOP's I'LL we're ''s", "a<|endoftext|>b", "x y z", "\x1fa\x1cb\x85", "ΑΣ ß ẞ İ ﬁ é é naïve CAFÉ", "1234 ½ ²", "", " \n\t", "日本 😀😀a", "µª×÷¿¡«»", "a\x0bb\x0cd\x00d\x7fe", "ÿŸÆØøþÞðÐ'S'T", "!!,.", "A.,B", "a \u0301b \n\u0338", "it,a.b's(c)'s d<\u0338 e|f x<|endoftext|>y, z<|ENDOFTEXT|>, é,…, H\u0331, 1,2 a1.b ×,÷."]
    for name, by_runs in (("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)):
        encode = packing.text_ids(name)
        assert encode.by_runs == by_runs
        ids, ends = encode(pa.array(odd), 7)
        for t, part in zip(odd, np.split(ids, ends[:-1])):
            assert part.tolist() == [*encode.tokenizer.encode(t, add_special_tokens=False).ids, 7], t
    assert [n for _, x in packing.in_portions(pa.array(["a" * 5, "b" * 3, "", "c" * 90, "d"]), 8) for n in [len(x)]] == [3, 1, 1]


# ---------------------------------------------------------------- 10 line dedup


def test_line_dedup_against_brute_force(docs, texts):
    got = Counter((r["doc_id"], r["text"], r["n_removed"]) for r in line_dedup(docs).collect())
    seen, want, done = {}, Counter(), {}
    for i, t in sorted(texts, key=lambda x: x[0]):
        if t is None:
            want[(i, None, 0)] += 1
            continue
        if (i, t) not in done:
            lines = t.split("\n")
            nb = [k for k, x in enumerate(lines) if WORD.search(x)]
            gone = set()
            for k in range(len(nb) - 2):
                key = tuple(lines[x] for x in nb[k : k + 3])
                if seen.setdefault(key, (i, k)) != (i, k):
                    gone.update(range(nb[k], nb[k + 2] + 1))
            done[(i, t)] = ("\n".join(x for k, x in enumerate(lines) if k not in gone), len(gone))
        want[(i, *done[(i, t)])] += 1
    assert got == want
    out = line_dedup(docs)
    assert out.columns[: len(docs.columns)] == docs.columns and out.where("text is not null and n_chars <> char_length(text)").count() == 0
    assert line_dedup(docs.limit(0)).count() == 0
