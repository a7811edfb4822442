"""Quality scores: ridge regression on random Fourier features of document statistics, calibrated."""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import BINS, fit_isotonic, id_crc, materialize

N_STATS = 16
#: Matrices that one task adds up.
FAN = 16


def text_stats(text: str | None) -> list[float]:
    """Statistics of a whole text, of either sign and modest size; an empty text has its own flag."""
    text = text or ""
    raw = text.encode()
    words = raw.split()
    if not words:
        return [0.0] * (N_STATS - 1) + [1.0]
    n, size = len(words), len(raw)
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    upper, digits = count[65:91].sum(), count[48:58].sum()
    letters = upper + count[97:123].sum() + count[128:].sum()
    space = count[[32, 9, 10, 11, 12, 13]].sum()
    symbols = count[[35, 42, 36, 37, 38, 124, 60, 62]].sum()
    stops = count[[33, 63]].sum()
    point = count[[46, 44, 59, 58]].sum()
    p = count[count > 0] / size
    lines = [x for x in raw.split(b"\n") if x.strip()]
    distinct = len(set(words))
    pairs = len(set(zip(words, words[1:]))) / max(1, n - 1) if n > 1 else 1.0
    top = Counter(words).most_common(1)[0][1] / n if distinct < n else 1.0 / n
    return [
        math.log1p(n) / 5,
        (size - space) / n / 10,
        4 * upper / max(1, letters),
        4 * digits / size,
        8 * symbols / size,
        8 * stops / size,
        8 * point / size,
        letters / size,
        distinct / n if n < 200 else distinct / n * math.log(n) / math.log(200),
        pairs,
        1 - len(set(lines)) / max(1, len(lines)),
        4 * top,
        float(-(p * np.log2(p)).sum()) / 4,
        math.log1p(n / max(1, len(lines))) / 4,
        8 * count[[61, 123, 125, 91, 93, 47, 92, 95, 64]].sum() / size,
        0.0,
    ]


def statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, x): the statistics of every whole text."""

    def run(batches):
        kind = pa.list_(pa.float64())
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([text_stats(t) for t in b.column(1).to_pylist()], kind)], ["doc_id", "x"])

    docs = docs.select("doc_id", "text")
    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, x array<double>")


@dataclass
class QualityModel:
    """Standardisation, the random features and their ridge weights, and the calibrated levels."""

    mean: np.ndarray
    scale: np.ndarray
    w: np.ndarray
    b: np.ndarray
    beta: np.ndarray
    levels: np.ndarray | None = None

    def features(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) / self.scale
        waves = np.cos(z @ self.w + self.b) * math.sqrt(2 / self.w.shape[1])
        return np.hstack([np.ones((len(x), 1)), z, waves])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.features(x) @ self.beta, 0, 1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return self.levels[np.minimum((self.raw(x) * BINS).astype(int), BINS - 1)]


def _normal_equations(rows: DataFrame, model: QualityModel) -> tuple[np.ndarray, np.ndarray]:
    """Sum of z z' and z y over all rows: in each partition, then FAN of these at a time until few are left, which the driver adds."""
    size = 1 + N_STATS + model.w.shape[1]

    def part(batches):
        total = np.zeros((size, size + 1))
        for b in batches:
            x = np.array(b.column(0).to_pylist(), float).reshape(-1, N_STATS)
            y = b.column(1).to_numpy(zero_copy_only=False).astype(float)
            z = model.features(x)
            total[:, :-1] += z.T @ z
            total[:, -1] += z.T @ y
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["m"])

    def add(batches):
        total = np.zeros((size, size + 1))
        for b in batches:
            for m in b.column(0).to_pylist():
                total += np.frombuffer(m).reshape(size, size + 1)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["m"])

    parts = rows.select("x", "label")
    left = parts.rdd.getNumPartitions()
    parts = parts.mapInArrow(part, "m binary")
    while left > FAN:
        left = -(-left // FAN)
        parts = parts.repartition(left).mapInArrow(add, "m binary")
    total = sum((np.frombuffer(r["m"]).reshape(size, size + 1) for r in parts.collect()), np.zeros((size, size + 1)))
    return total[:, :-1], total[:, -1]


def fit_quality(stats: DataFrame, labels: DataFrame, width: int = 256, gamma: float = 0.25, ridge: float = 1e-3, seed: int = 7, folds: int = 5) -> QualityModel:
    """Fit on labelled rows whose crc32(doc_id as text) mod folds is not 0.

    stats: (doc_id, x). labels: (doc_id, label 0 or 1; null rows do not count). Rows with the last
    remainder calibrate, the others fit the ridge weights; all labelled rows are used. Without any
    rows every score is 0.5.
    """
    rows = stats.join(labels.where("label is not null").select("doc_id", F.col("label").cast("double")), "doc_id").where(id_crc() % folds != 0)
    rows = materialize(rows, "labelled")
    fit, hold = rows.where(id_crc() % folds != folds - 1), rows.where(id_crc() % folds == folds - 1)
    moments = fit.agg(F.count(F.lit(1)), *[F.avg(F.col("x")[i]) for i in range(N_STATS)], *[F.stddev_pop(F.col("x")[i]) for i in range(N_STATS)]).first()
    if not moments[0]:
        mean, scale = np.zeros(N_STATS), np.ones(N_STATS)
    else:
        mean = np.array(moments[1 : N_STATS + 1], float)
        scale = np.maximum(np.array(moments[N_STATS + 1 :], float), 1e-2)
    rng = np.random.default_rng(seed)
    model = QualityModel(mean, scale, rng.normal(0, gamma, (N_STATS, width)), rng.uniform(0, 2 * math.pi, width), np.zeros(1 + N_STATS + width))
    if not moments[0]:
        model.levels = np.full(BINS, 0.5)
        return model
    a, y = _normal_equations(fit, model)
    lean = ridge * moments[0] * np.eye(len(y)) / len(y)
    lean[0, 0] = 0
    model.beta = np.linalg.lstsq(a + lean + 1e-9 * np.eye(len(y)), y, rcond=None)[0]

    def raw(batches):
        for b in batches:
            x = np.array(b.column(0).to_pylist(), float).reshape(-1, N_STATS)
            yield pa.RecordBatch.from_arrays([pa.array(model.raw(x)), b.column(1)], ["raw", "label"])

    model.levels = np.array(fit_isotonic(hold.select("x", "label").mapInArrow(raw, "raw double, label double"), "raw", "label"))
    return model


def score_quality(stats: DataFrame, model: QualityModel) -> DataFrame:
    """(doc_id, score) for every row of stats."""

    def run(batches):
        for b in batches:
            x = np.array(b.column(1).to_pylist(), float).reshape(-1, N_STATS)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(x))], ["doc_id", "score"])

    return stats.mapInArrow(run, f"doc_id {stats.schema['doc_id'].dataType.simpleString()}, score double")


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per row of docs: doc_id and score from 0 to 1 (higher: label 1 likelier).

    Null texts count as empty; empty texts get a score like any other. Rows that repeat get equal
    scores, a document labelled twice counts twice, and empty tables give no rows or scores of 0.5.
    Other columns are not read.
    """
    stats = materialize(statistics(docs), "stats")
    return score_quality(stats, fit_quality(stats, labels))


def keep_good(docs: DataFrame, labels: DataFrame, least: float = 0.3) -> DataFrame:
    """The rows of docs, all columns, whose score is least or more.

    Statistics are made twice, once to fit and once to decide, so that texts are never shuffled.
    """
    model = fit_quality(materialize(statistics(docs), "stats"), labels)
    at = docs.columns.index("text")

    def run(batches):
        for b in batches:
            x = np.array([text_stats(t) for t in b.column(at).to_pylist()], float).reshape(-1, N_STATS)
            yield b.filter(pa.array(model.score(x) >= least))

    return docs.mapInArrow(run, docs.schema)
