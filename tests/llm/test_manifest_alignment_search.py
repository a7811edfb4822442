"""Operators 11 to 13 against plain Python: nulls, ties, repeats, long and odd texts, clashing columns, empty tables."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from pyspark.sql import functions as F

from tessella.llm import alignment as A
from tessella.llm import merkle as M
from tessella.llm import topk as T
from tessella.llm.common import id_crc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


# ---------------------------------------------------------------- 11 Merkle manifest


def plain_manifest(rows, fan):
    """[(doc_id, leaf, subroot, root, siblings, levels)] by following the definition."""
    sha = lambda x: hashlib.sha256("".join(x).encode()).hexdigest()
    leaf = lambda r: sha("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r[0], r[3], r[2], r[4], r[1]))

    def tree(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([sha(out[-1][i : i + fan]) for i in range(0, len(out[-1]), fan)])
        return out

    def path(levels, k):
        for level in levels[:-1]:
            first = k // fan * fan
            yield level[first:k], level[k + 1 : first + fan]
            k //= fan

    langs = sorted({r[2] for r in rows}, key=lambda x: (x is not None, (x or "").encode()))
    own = {lang: sorted(((r[0] is not None, r[0] or 0, leaf(r)), r[0]) for r in rows if r[2] == lang) for lang in langs}
    trees = {lang: tree([k[2] for k, _ in own[lang]]) for lang in langs}
    top = tree([trees[lang][-1][0] for lang in langs])
    out = []
    for i, lang in enumerate(langs):
        for j, (k, doc) in enumerate(own[lang]):
            steps = [*path(trees[lang], j), *path(top, i)]
            out.append((doc, k[2], trees[lang][-1][0], top[-1][0], sha(x for a, b in steps for x in a + b), len(steps)))
    return out


def manifest_rows(n, langs, seed=4):
    rng = random.Random(seed)
    rows = [(i, rng.choice(["é" * (i % 5), None, "", "a:b\n" * 3]), rng.choice(langs), rng.choice(["s", None]), rng.choice([i, None, -3])) for i in rng.sample(range(10 * n), n)]
    return rows + [(None, "x", langs[0], "s", 1), (None, None, langs[0], None, None)] + [rows[0]] * 3 if n else rows


@pytest.mark.parametrize("fan, n, langs", [(2, 1, ["en"]), (2, 700, ["en"] * 6 + ["de", None, "", "ž"]), (3, 400, ["a", None]), (16, 600, ["b"])])
def test_manifest_against_the_definition(spark, fan, n, langs):
    rows = manifest_rows(n, langs)
    docs = spark.createDataFrame(rows, DOCS)
    for c in ("tree", "rank", "leaf", "digest", "n", "i", "_at", "path", "keys"):
        docs = docs.withColumn(c, F.lit("clash"))
    manifest = M.build_manifest(docs, fan=fan)
    got = manifest.prove().select("doc_id", "leaf", "found", "subroot", M.proof_digest(F.col("proof")).alias("p"), M.fold(F.col("leaf"), F.col("proof")).alias("back"), F.size("proof").alias("steps")).collect()
    want = plain_manifest(rows, fan)
    assert Counter((r["doc_id"], r["leaf"], r["subroot"], manifest.root, r["p"], r["steps"]) for r in got) == Counter(want)
    assert all(r["back"] == manifest.root and r["found"] == r["leaf"] for r in got)


def test_some_requests_and_tampering(spark):
    rows = manifest_rows(900, ["en", "en", "en", "de"])
    docs = spark.createDataFrame(rows, DOCS).repartition(7)
    manifest = M.build_manifest(docs, {"changed": F.when(id_crc() % 7 == 0, M.document_digest(F.col("n_chars") + 1))})
    few = manifest.leaves.where("rank % 97 = 5 or rank = 0").withColumn("claim", F.coalesce("changed", "leaf"))
    got = manifest.prove(few.select("tree", "rank", "doc_id", "leaf", "claim")).withColumn("back", M.fold(F.col("claim"), F.col("proof"))).collect()
    assert len(got) == few.count() > 8
    n_chars = {r[0]: r[4] for r in rows}
    for r in got:
        tampered = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0 and n_chars[r["doc_id"]] is not None
        assert (r["back"] == manifest.root) != tampered
    assert {r["back"] == manifest.root for r in got} == {True, False}


def test_records_are_addressed_by_content(spark):
    manifest = M.build_manifest(spark.createDataFrame(manifest_rows(600, ["en"]), DOCS))
    packs = [r for p in manifest.packs for r in p.collect()]
    known = {k: c for r in packs for k, c in zip(r["keys"], r["children"])}
    assert packs and all(hashlib.sha256("".join(c).encode()).hexdigest() == k and len(c) <= 2 for k, c in known.items())
    assert max(len(r["keys"]) for r in packs) < M.SPAN and manifest.root in known or len(packs) > 1


def test_manifest_of_nothing(spark):
    manifest = M.build_manifest(spark.createDataFrame([], DOCS))
    assert manifest.root is None and manifest.prove().count() == 0


# ---------------------------------------------------------------- 12 alignment


@pytest.fixture(scope="module")
def pair():
    import public_tokenizers as P

    return A.Tokenizers(P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"))


def odd_texts(n, seed):
    rng = random.Random(seed)
    parts = ["a", "b c", "  ", " ", "\n", " \n", "\t", "don't", "x y", " ", "é", "é", " ́", "日本語 の", "<|endoftext|>", "<s>", "▁", "\x00", "　", "1234", "...", "!?", "😀", " word", "The", "ﬁ", "\r\n", "\u0085", " ​", "$x = {y};"]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 14))) for _ in range(n)]


def plain_alignment(rows, t):
    """doc_id -> row of align(), by whole encodings, sets of ends and plain counting."""
    per, count = [], Counter()
    for i, text in rows:
        a, b, whole = t.a.encode(" " + (text or ""), add_special_tokens=False).ids, t.b.encode(text or ""), (" " + (text or "")).encode()
        if not text or b"".join(t.bytes_a[x] for x in a) != whole or b"".join(t.bytes_b[x] for x in b) != whole:
            per.append((i, 0, 0, [], ""))
            continue
        ends = [np.cumsum([len(table[x]) for x in ids]).tolist() for ids, table in ((a, t.bytes_a), (b, t.bytes_b))]
        links, groups, pa_, pb = [], [], 0, 0
        for e in sorted(set(ends[0]) & set(ends[1])):
            ja, jb = ends[0].index(e) + 1, ends[1].index(e) + 1
            groups.append(",".join(map(str, a[pa_:ja])) + "|" + ",".join(map(str, b[pb:jb])))
            links.append((a[ja - 1], b[jb - 1]))
            pa_, pb = ja, jb
        count.update(links)
        per.append((i, len(a), len(b), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    best = {}
    for (_, b), n in count.items():
        best[b] = max(best.get(b, 0), n)
    return Counter((i, na, nb, len(x), len(x), sum(count[p] == best[p[1]] for p in x), sum(count[p] for p in x), d) for i, na, nb, x, d in per)


def test_pieces_are_encoded_as_whole_texts_are(pair):
    texts = odd_texts(4000, 1) + ["", " x", "x ", "a b" * 3000, "a" * 30_000, " "]
    ids_a, upto_a, ids_b, upto_b, good = pair.encode(pa.array(texts))
    at = (0, 0)
    for i, text in enumerate(texts):
        a, b = pair.a.encode(" " + text, add_special_tokens=False).ids, pair.b.encode(text)
        same = bool(text) and b"".join(pair.bytes_a[x] for x in a) == (" " + text).encode() == b"".join(pair.bytes_b[x] for x in b)
        assert good[i] == same, text
        assert (ids_a[at[0] : upto_a[i]].tolist(), ids_b[at[1] : upto_b[i]].tolist()) == ((a, b) if same else ([], [])), text
        at = upto_a[i], upto_b[i]
    assert 0 < good.sum() < len(good) and pair.cuts and pair.ranks is not None


def test_galloping_against_search():
    rng = np.random.default_rng(2)
    for _ in range(300):
        y = np.unique(rng.integers(0, 500, rng.integers(1, 200)))
        x = np.sort(rng.integers(-5, y[-1] + 1, rng.integers(0, 50)))
        assert (A.gallop(x, y, rng.integers(0, len(y), len(x))) == np.searchsorted(y, x)).all()
    for _ in range(200):
        ends, upto = [[], []], [[], []]
        base = 0
        for _ in range(rng.integers(1, 6)):
            size = rng.integers(0, 60)
            for e, u in zip(ends, upto):
                e.extend(base + np.unique(np.append(rng.integers(1, size + 1, rng.integers(0, size + 1)), size)) if size else [])
                u.append(len(e))
            base += size
        (a, b), (ua, ub) = [np.array(e, np.int64) for e in ends], [np.array(u, np.int64) for u in upto]
        _, want_a, want_b = np.intersect1d(a, b, return_indices=True)
        got = A.common_ends(a, ua, b, ub)
        assert (got[0] == want_a).all() and (got[1] == want_b).all()


def test_alignment_against_plain_counting(spark, pair, monkeypatch):
    texts = odd_texts(300, 3)
    rows = [(i, t) for i, t in enumerate(texts)] + [(7, texts[0]), (7, texts[0]), (None, "a b"), (None, None), (900, None), (901, "long text, " * 4000)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS).repartition(5)
    for c in ("chunk", "at", "pairs", "times", "count", "best", "n_a"):
        docs = docs.withColumn(c, F.lit("clash"))
    monkeypatch.setattr(A, "CHUNK", 500)
    got = Counter(tuple(r) for r in A.align(docs).collect())
    assert got == plain_alignment(rows, pair)
    assert A.align(docs.limit(0)).count() == 0


# ---------------------------------------------------------------- 13 exact top-k


def plain_top(rows, asked, k, scale=64):
    """(query place, [(vec_id, score)]) with whole numbers."""
    ok = [(p, i, [int(np.floor(scale * float(x))) for x in v]) for p, (i, v) in enumerate(rows) if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for p, i, v in ok:
        if asked(i):
            scores = [(-sum(a * b for a, b in zip(v, w)), j is None, j or 0) for q, j, w in ok if q != p]
            out += [(i, n + 1, None if none else j, -s) for n, (s, none, j) in enumerate(sorted(scores)[:k])]
    return Counter(out)


def vectors(spark, rows, parts=5):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], "clash", 1.0, 3) for i, v in rows], "vec_id long, embedding array<double>, row string, score double, block int").repartition(parts)


@pytest.mark.parametrize("kind", ["plain", "grouped", "equal", "positive", "sparse"])
def test_top_k_against_all_pairs(spark, monkeypatch, kind):
    monkeypatch.setattr(T, "FEW", 60)
    monkeypatch.setattr(T, "CELLS", 80 * 12)
    monkeypatch.setattr(T, "TILE", 32)
    monkeypatch.setattr(T, "ROUND", 7)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(420, 12)) / 3
    if kind == "grouped":
        x = x[rng.integers(0, 9, 420)] + rng.normal(size=(420, 12)) / 50
    if kind == "equal":
        x[50:250] = x[0]
    if kind == "positive":
        x = np.abs(x) + 1
    if kind == "sparse":
        x[rng.random(x.shape) < 0.8] = 0.003
    rows = [(int(i), v.tolist()) for i, v in zip(rng.permutation(420), x)]
    rows += [(None, rows[3][1]), (20, rows[4][1]), (20, rows[4][1]), (40, None), (60, [None] * 12), (80, [float("nan")] * 12), (100, [float("inf")] + [0.0] * 11), (120, [0.0] * 12), (140, [0.5] * 3), (160, [])]
    got = Counter(tuple(r) for r in T.top_k(vectors(spark, rows), F.col("vec_id") % 4 == 0, k=6).collect())
    assert got == plain_top(rows, lambda i: i is not None and i % 4 == 0, 6)


def test_top_k_of_few_and_of_huge_numbers(spark):
    rows = [(0, [1e15, 2.0]), (1, [3e5, -1.0]), (2, [-2e5, 4.0]), (20, [1.0, 1.0])]
    got = Counter(tuple(r) for r in T.top_k(vectors(spark, rows, 2), F.col("vec_id") % 20 == 0).collect())
    cut = lambda s: max(-(2**63) + 1, min(2**63 - 1, s))
    assert got == Counter((i, r, j, cut(s)) for i, r, j, s in plain_top(rows, lambda i: i % 20 == 0, 20).elements())
    nothing = vectors(spark, rows, 2).limit(0)
    assert T.top_k(nothing, F.lit(True)).count() == 0
    assert T.top_k(vectors(spark, rows, 2), F.lit(False)).count() == 0
    assert T.top_k(vectors(spark, rows[:1], 1), F.lit(True)).count() == 0


def test_bounds_leave_work_undone(monkeypatch):
    """With a least to reach, most candidates of groups are dropped before all their terms are added, and none that counts."""
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(40, 32))
    v = np.floor(64 * (centres[rng.integers(0, 40, 3000)] + rng.normal(size=(3000, 32)) / 20))
    w = np.floor(64 * (centres[:20] + rng.normal(size=(20, 32)) / 20))
    full = w @ v.T
    least = np.sort(full, axis=1)[:, -20]
    for sparse in (0.0, 1.0):
        monkeypatch.setattr(T, "SPARSE", sparse)
        q, c, s = T.competitive(w, v, v.max(0), v.min(0), least)
        assert set(zip(q.tolist(), c.tolist())) == set(zip(*(x.tolist() for x in np.nonzero(full >= least[:, None])))) and (s == full[q, c]).all()
    q, c, s = T.competitive(w, v, v.max(0), v.min(0), np.full(20, 1e12))
    assert len(q) == 0
