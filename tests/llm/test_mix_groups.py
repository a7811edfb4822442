"""Rows alike in the mix, rows without an id, and buckets far smaller than a group."""

import hashlib
from collections import Counter

import pytest

from tessella.llm import mixing, packing


@pytest.fixture(scope="module")
def alike(spark):
    rows = [(None, " ".join(f"w{i % 7}x{j}" for j in range(1 + i % 3)), "en", None, 0) for i in range(90)]
    rows += [(5, "five words are in here", "en", "a", 0)] * 40 + [(i, "some words " * (i % 9), "en", "ab"[i % 2], 0) for i in range(60)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)


def plain_mix(rows, weights=(3, 1, 2), share=1.5, most=2):
    """Words taken of each (doc_id, source, size) by sorting everything, one row after the other."""
    lot = [(r["doc_id"], r["source"], len((r["text"] or "").split())) for r in rows]
    size = Counter()
    for _, s, n in lot:
        size[s] += n
    order = sorted((s for s in size if s is not None)) + [None]
    w = {s: weights[i % 3] for i, s in enumerate(order)}
    full, left = set(), share * sum(size.values())
    while over := {s for s in size if s not in full and left / sum(w[x] for x in size if x not in full) * w[s] > most * size[s]}:
        full |= over
        left -= sum(most * size[s] for s in over)
    free = sum(w[x] for x in size if x not in full)
    target = {s: most * size[s] if s in full else left / free * w[s] for s in size}
    key = lambda x: (hashlib.md5(("" if x[0] is None else str(x[0])).encode()).hexdigest(), x[2])
    timed, upto = [], Counter()
    for d, s, n in sorted((x for x in lot if x[2]), key=key):
        upto[s] += n
        timed += [((upto[s] + t * size[s]) / target[s], -1 if d is None else d, t, d, s, n) for t in range(most)]
    taken, spent = Counter(), 0
    for _, _, _, d, s, n in sorted(timed, key=lambda x: x[:3]):
        spent += n
        if spent > sum(target.values()):
            break
        taken[d, s, n] += n
    return taken


@pytest.mark.parametrize("most_rows", [100_000, 7])
def test_mix_equals_plain_queue(alike, monkeypatch, most_rows):
    monkeypatch.setattr(mixing, "ROWS_PER_BUCKET", most_rows)
    rows = mixing.fair_mix(alike).collect()
    assert len(rows) == 190
    got = Counter()
    for r in rows:
        got[r["doc_id"], r["source"], r["size"]] += r["taken"]
        assert r["taken"] in (0, r["size"], 2 * r["size"])
    assert +got == plain_mix(alike.collect())


@pytest.mark.parametrize("most_rows", [100_000, 7])
def test_taken_rows_are_those_of_the_mix(alike, monkeypatch, most_rows):
    monkeypatch.setattr(mixing, "ROWS_PER_BUCKET", most_rows)
    out = mixing.take_mix(alike)
    got = Counter()
    for r in out.collect():
        n = len(r["text"].split())
        got[r["doc_id"], r["source"], n] += n
    assert out.columns == alike.columns and got == plain_mix(alike.collect())
    assert mixing.take_mix(alike.limit(0)).count() == 0


def test_packing_in_small_buckets(alike, monkeypatch):
    monkeypatch.setattr(packing, "ROWS_PER_BUCKET", 9)
    rows = packing.pack(alike, most=16).collect()
    assert Counter(r["doc_id"] for r in rows if r["piece"] == 0) == Counter(r["doc_id"] for r in alike.collect())
    held = {}
    for r in rows:
        held.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in held.values():
        upto = 0
        for offset, length in sorted(places):
            assert offset == upto
            upto += length
        assert upto <= 16
