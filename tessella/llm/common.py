"""Pieces that several operators share: word splitting, rows of any column names, calibration."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.shared import discard, stored as materialize  # noqa: F401

#: Words are maximal runs of anything but these six ASCII white-space characters.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def beside(docs: DataFrame) -> DataFrame:
    """docs with its columns called _0, _1, ..., so that none clashes with what is joined to them."""
    return docs.select(*[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(docs.columns)])


def named(numbered: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs under their own names, from a frame that holds them as beside() calls them."""
    return numbered.select(*[F.col(f"_{i}").alias(c) for i, c in enumerate(docs.columns)])


def place_of(docs: DataFrame, column: str) -> Column:
    """The column of docs in what beside() makes of it."""
    return F.col(f"_{docs.columns.index(column)}")


def tie_of(text: Column) -> Column:
    """128 bits that tell texts with one doc_id apart; null and the empty text differ."""
    return F.md5(F.coalesce(F.concat(F.lit("="), text), F.lit("")).cast("binary"))


def one_of_each(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """The rows of docs, all columns, of which one row of each group stays.

    groups: (doc_id, tie, g) for every row of docs, tie being tie_of the text. The smallest
    doc_id of a group stays (null last, then by tie); of rows that repeat with the same doc_id and
    text one stays.
    """
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tie")
    groups = materialize(groups.select("g", order.alias("x")), "groups")
    first = groups.groupBy("g").agg(F.min("x").alias("first"))
    gone = groups.join(first, "g").where("x <> first").select(F.col("x.doc_id").alias("gone"), F.col("x.tie").alias("gone_tie")).distinct()
    again = groups.groupBy("x").count().where("count > 1").limit(1).count()
    rows = beside(docs).withColumn("tie", tie_of(place_of(docs, "text")))
    who = place_of(docs, "doc_id")
    gone = materialize(gone, "gone")
    discard(groups)
    out = rows.join(gone, who.eqNullSafe(F.col("gone")) & (F.col("tie") == F.col("gone_tie")), "left_anti")
    return named(out.dropDuplicates([f"_{docs.columns.index('doc_id')}", "tie"]) if again else out, docs)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def words_of(text: Column) -> Column:
    """Array of the words of a text; null counts as empty."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def id_crc(doc_id: str = "doc_id") -> Column:
    """crc32 of an id written as text."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary"))


#: Bytes of text that a task splits at once; a longer text is split alone.
AT_ONCE = 32_000_000


def in_portions(texts: pa.Array, most: int = AT_ONCE):
    """(first row, rows) of an Arrow batch with at most so many bytes of text each; a longer text stands alone."""
    size = pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False)
    at = 0
    while at < len(texts):
        n = max(1, int(np.searchsorted(np.cumsum(size[at:]), most, side="right")))
        yield at, texts.slice(at, n)
        at += n


# ---------------------------------------------------------------- isotonic calibration

BINS = 1000


def pool_adjacent(mean: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weighted isotonic (non-decreasing) fit: neighbours that violate the order are pooled."""
    blocks: list[list[float]] = []
    for m, w in zip(mean, weight):
        blocks.append([m, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            m2, w2, n2 = blocks.pop()
            m1, w1, n1 = blocks.pop()
            blocks.append([(m1 * w1 + m2 * w2) / (w1 + w2), w1 + w2, n1 + n2])
    return np.concatenate([[b[0]] * int(b[2]) for b in blocks]) if blocks else np.zeros(0)


def score_bin(raw: Column) -> Column:
    """Bin of a raw score between 0 and 1."""
    return F.least(F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw)) * BINS), F.lit(BINS - 1)).cast("int")


def fit_isotonic(scored: DataFrame, raw: str, label: str, lean: float = 0.5) -> list[float]:
    """Calibrated probability for each of BINS bins of a raw score.

    The labelled rows are counted by bin in Spark; only the counts (BINS rows at most) reach the
    driver. Each level leans towards the overall rate by lean rows' worth, so that one row alone
    does not give a certainty. Without rows every bin gets 0.5.
    """
    rows = scored.groupBy(score_bin(F.col(raw)).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("double")).alias("pos")).collect()
    if not rows:
        return [0.5] * BINS
    rows.sort(key=lambda r: r["bin"])
    at = np.array([r["bin"] for r in rows], float)
    n, pos = np.array([r["n"] for r in rows], float), np.array([r["pos"] for r in rows], float)
    prior = (pos.sum() + 1) / (n.sum() + 2)
    fitted = pool_adjacent(pos / n, n)
    for level in np.unique(fitted):
        on = fitted == level
        fitted[on] = (level * n[on].sum() + lean * prior) / (n[on].sum() + lean)
    fitted = np.maximum.accumulate(fitted)
    return [float(x) for x in np.interp(np.arange(BINS), at, fitted)]


def calibrated(raw: Column, table: list[float]) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in table]), score_bin(raw) + 1)
