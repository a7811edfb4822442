"""A corpus made ready for training in five stages, each written as Parquet and read again by the next.

STAGES holds (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame. All
but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import materialize
from tessella.llm.line_dedup import line_dedup
from tessella.llm.mixing import take_mix
from tessella.llm.near_dedup import near_dedup
from tessella.llm.packing import pack
from tessella.llm.quality_classifier import keep_good


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go.

    Null and empty texts are scored like any other, texts of any length whole. Rows that repeat are
    judged alike; a null doc_id has no label but is judged. An empty table gives no rows; without
    labels every score is 0.5 and all stay. Other columns stay as they are.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    return keep_good(docs, labels)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of passages of three lines, or of fewer with over 50 words, go; every document stays.

    Null and empty texts are unchanged; a text that repeats whole becomes empty. The first of equal
    passages by (doc_id, place) stays, null ids first; rows that repeat are cut alike. An empty
    table gives no rows. Other columns stay, n_chars follows the text; a column of docs called
    n_lines or n_removed is the operator's own and comes back with its counts.
    """
    return line_dedup(docs, over=50).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays; links are 0.8 or more of the five-word shingles in common.

    Null and empty texts are one group. The smallest doc_id stays (null last, then by text); of rows
    that repeat one stays, and different texts with one doc_id are documents of their own. An empty
    table gives no rows. Other columns stay as they are.
    """
    return near_dedup(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it.

    Documents without words (null and empty texts) are never taken. A null source is a source, a
    null doc_id an id. Rows that repeat share what is taken of them. An empty table gives no rows.
    Other columns stay as they are.
    """
    return take_mix(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces with their places in sequences of at most 2048 tokens.

    Null and empty texts are the end id alone; longer documents are cut. Rows that repeat are
    documents of their own. An empty table gives no rows. Other columns are not read.
    """
    return pack(docs)


STAGES = [("quality_classifier", quality), ("line_dedup", lines), ("simhash_near_dedup", near_duplicates), ("source_mix", mix), ("best_fit_packing", packing)]

#: Learned scores, connected components and packing have no SQL form; the tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
