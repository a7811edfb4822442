"""Toxicity: gradient-boosted trees over dense features of the text, with isotonic calibration."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import calibrated, fit_isotonic, id_crc, in_portions, materialize

#: Common insults and second-person words.
INSULTS = "idiot idiots moron morons stupid dumb loser losers scum trash worthless pathetic disgusting clown clowns fool fools jerk jerks garbage filth filthy vermin creep ugly imbecile cretin pig swine rat coward liar freak bastard".split()
SECOND = "you your yours yourself u ur du dich dir dein deine ihr euch euer tu te toi ton ta tes vous votre vos tú ti tuyo usted ustedes vosotros".split()
#: Signs that stand for letters.
LEET = str.maketrans("0134578@$!", "oieastbasi")
TRIM = ".,;:!?\"'()[]{}*#$%&|<>-_~"
NEAR = 5
STEMS = (4, 5, 6)
N_FEATURES = 14


def tokens_of(word: str) -> list[str]:
    """The word without outer signs and the stems it begins with."""
    w = word.strip(TRIM)
    return [w, *(w[:k] + "^" for k in STEMS if len(w) > k)] if w else []


def learn_lexicon(docs: DataFrame, labels: DataFrame, sample: int = 20_000, least_g: float = 17.0, most: int = 20_000, spread: float = 0.3) -> dict[str, float]:
    """Words and stems typical of toxic documents, with their log-odds.

    labels: (doc_id, label), training rows only. Learned from a bounded sample: the sample labelled
    documents of smallest hash, whose ids are broadcast (sample ids at most), so no text is shuffled.
    An entry needs a log-likelihood ratio of least_g and more toxic documents than others; the most strongest are candidates. Copies of one
    toxic document make all its words look typical, so a candidate must also stand between different
    pairs of neighbours: three at least, and spread times the documents that hold it.
    """
    picked = labels.where("label is not null").select("doc_id", "label").orderBy(F.xxhash64("doc_id"), "label").limit(sample)
    texts = docs.select("doc_id", "text").join(F.broadcast(materialize(picked, "sample")), "doc_id").select("text", "label")

    def run(batches):
        for b in batches:
            toxic, every = Counter(), Counter()
            for t, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                found = {x for w in set((t or "").lower().split()) for x in tokens_of(w)}
                every.update(found)
                if y:
                    toxic.update(found)
            yield pa.RecordBatch.from_arrays([pa.array(list(every), pa.string()), pa.array([toxic[k] for k in every], pa.int64()), pa.array(list(every.values()), pa.int64())], ["token", "t", "n"])

    totals = picked.agg(F.sum(F.col("label").cast("long")), F.count(F.lit(1))).first()
    hot, total = totals[0] or 0, totals[1]
    if not hot or hot == total:
        return {}
    share = hot / total
    t, n = F.col("t").cast("double"), F.col("n").cast("double")
    xlog = lambda a, e: F.when(a > 0, a * F.ln(a / e)).otherwise(0.0)
    g = 2 * (xlog(t, n * share) + xlog(n - t, n * (1 - share)))
    odds = F.ln((t + 0.5) / (hot + 1)) - F.ln((n - t + 0.5) / (total - hot + 1))
    counts = texts.mapInArrow(run, "token string, t long, n long").groupBy("token").agg(F.sum("t").alias("t"), F.sum("n").alias("n"))
    best = counts.where((t > n * share * 2) & (t > n * 0.5) & (g >= least_g)).select("token", odds.alias("odds"), g.alias("g"), "t").orderBy(F.desc("g"), "token").limit(most).collect()
    found = {r["token"]: (r["odds"], r["t"]) for r in best}

    def places(batches):
        for b in batches:
            seen = set()
            for t in b.column(0).to_pylist():
                words = ["", *(t or "").lower().split(), ""]
                for before, w, after in zip(words, words[1:], words[2:]):
                    seen.update((x, f"{before} {after}") for x in tokens_of(w) if x in found)
            tokens, around = zip(*seen) if seen else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(tokens, pa.string()), pa.array(around, pa.string())], ["token", "around"])

    contexts = texts.where("label > 0").select("text").mapInArrow(places, "token string, around string").groupBy("token").agg(F.countDistinct("around").alias("c"))
    varied = {r["token"]: r["c"] for r in contexts.collect()}
    return {w: odds for w, (odds, t) in found.items() if varied.get(w, 0) >= max(3, spread * t)}


class WordCodes(dict):
    """Flags of a word by its spelling, kept for the words seen: 1 lexicon, 2 insult, 4 second person,
    8 digits or signs among letters, 16 an insult once these are read as letters, 32 capitals."""

    def __init__(self, lexicon: dict[str, float]):
        super().__init__()
        self.lexicon, self.insults, self.second = lexicon, set(INSULTS), set(SECOND)

    def __missing__(self, word: str) -> int:
        if len(self) > 300_000:
            self.clear()
        low = word.lower()
        bare = low.strip(TRIM)
        inner = any(a.isalpha() and b.isalpha() and not c.isalpha() and c not in "'-’" for a, c, b in zip(bare, bare[1:], bare[2:]))
        plain = "".join(c for c in low.strip(".,;:?\"'").translate(LEET) if c.isalpha())
        code = any(t in self.lexicon for t in tokens_of(low))
        code |= 2 * (bare in self.insults) | 4 * (bare in self.second) | 8 * inner
        code |= 16 * (plain != bare and (plain in self.insults or plain in self.lexicon)) | 32 * (len(bare) > 1 and word.strip(TRIM).isupper())
        self[word] = code
        return code


def toxic_features(texts: pa.Array, codes: WordCodes) -> np.ndarray:
    """N_FEATURES numbers for every whole text of a batch without nulls; all zero where there is no word.

    Words are numbered in Arrow, each distinct one gets its flags once, and the texts' counts are
    sums over the places of flagged words.
    """
    rows = len(texts)
    split = pc.ascii_split_whitespace(texts)
    doc = np.repeat(np.arange(rows), np.diff(split.offsets.to_numpy()))
    words = split.flatten().dictionary_encode()
    spelled, at = words.dictionary.to_pylist(), words.indices.to_numpy()
    flags = np.fromiter((codes[w] if w else -1 for w in spelled), np.int64, len(spelled))
    doc, at = doc[flags[at] >= 0], at[flags[at] >= 0]  # blanks at a text's ends leave an empty word
    code = flags[at]

    def per_text(on: np.ndarray) -> np.ndarray:
        return np.bincount(doc[on], minlength=rows).astype(float)

    lexicon, insult, second, inner, leet, capital = (per_text((code & k) > 0) for k in (1, 2, 4, 8, 16, 32))
    bad, you = np.flatnonzero(code & 19), np.flatnonzero(code & 4)
    gap = np.full(len(bad), 1000)
    if len(you):
        k = np.searchsorted(you, bad)
        for other in (you[np.minimum(k, len(you) - 1)], you[np.maximum(k - 1, 0)]):
            gap = np.where(doc[other] == doc[bad], np.minimum(gap, np.abs(other - bad)), gap)
    near, least = np.bincount(doc[bad[gap <= NEAR]], minlength=rows), np.full(rows, 1000)
    np.minimum.at(least, doc[bad], gap)
    # spellings of flagged words that differ only in case and outer signs count once
    named: dict[str, int] = {}
    bare = np.zeros(len(spelled), np.int64)
    for i in np.unique(at[bad]):
        bare[i] = named.setdefault(spelled[i].lower().strip(TRIM), len(named))
    different = np.unique(doc[bad] * max(1, len(named)) + bare[at[bad]]) // max(1, len(named))
    n = np.bincount(doc, minlength=rows).astype(float)
    size, each = np.maximum(pc.utf8_length(texts).to_numpy(), 1), np.maximum(n, 1)
    stops, signs = (sum(pc.count_substring(texts, c).to_numpy() for c in group) for group in ("!?", "*#$@"))
    x = np.stack([lexicon / each, np.log1p(lexicon), insult / each, np.log1p(insult), np.bincount(different, minlength=rows), near / each, np.log1p(least), second / each, capital / each, stops / size, signs / size, inner / each, leet / each, np.log1p(n)], 1)
    return np.where(n[:, None] > 0, x, 0.0)


def dense_features(docs: DataFrame, lexicon: dict[str, float]) -> DataFrame:
    """(doc_id, x) for every row, from whole texts."""

    def run(batches):
        codes = WordCodes(lexicon)
        for b in batches:
            for first, texts in in_portions(b.column(1).fill_null("")):
                x = toxic_features(texts, codes)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * N_FEATURES), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, len(x)), lists], ["doc_id", "x"])

    docs = docs.select("doc_id", "text")
    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, x array<double>")


def toxicity_scores(docs: DataFrame, labels: DataFrame, folds: int = 3, held: int = 1, trees: int = 15, depth: int = 4, sample: int = 20_000) -> DataFrame:
    """One row per row of docs: doc_id and score from 0 to 1 (higher: label 1 likelier).

    labels: (doc_id, label). Only rows whose crc32(doc_id as text) mod folds is not held are learned
    from: the lexicon from at most sample of them, trees and calibration from all. A quarter of them
    (by the next digit of the hash) only calibrates. Null texts count as empty and are scored like
    any other; null labels do not count; rows that repeat get equal scores; with one class or no
    labels every score is the share of label 1, or 0.5. Other columns are not read.
    """
    train = labels.where("label is not null").select("doc_id", F.col("label").cast("double")).where(id_crc() % folds != held)
    x = materialize(dense_features(docs, learn_lexicon(docs, train, sample)), "features")
    vector = x.withColumn("features", array_to_vector("x"))
    rows = materialize(x.join(train, "doc_id"), "labelled").withColumn("features", array_to_vector("x"))
    known = rows.agg(F.count(F.lit(1)), F.avg("label")).first()
    if not known[0] or known[1] in (0.0, 1.0):
        return x.select("doc_id", F.lit(known[1] if known[0] else 0.5).cast("double").alias("score"))
    quarter = (id_crc() / folds).cast("long") % 4 == 3
    fit = rows.where(~quarter)
    if fit.select("label").distinct().count() < 2:
        fit = rows
    model = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.3, seed=11, cacheNodeIds=False).fit(fit.select("features", "label"))
    raw = vector_to_array("probability")[1]
    levels = fit_isotonic(model.transform(rows.where(quarter)).select(raw.alias("raw"), "label"), "raw", "label")
    return model.transform(vector).select("doc_id", calibrated(raw, levels).alias("score"))
