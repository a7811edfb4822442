"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.alignment import align
from tessella.llm.common import id_crc
from tessella.llm.embedding_dedup import embedding_classes
from tessella.llm.line_dedup import line_dedup
from tessella.llm.merkle import build_manifest, document_digest, fold, proof_digest
from tessella.llm.mixing import fair_mix
from tessella.llm.packing import pack
from tessella.llm.quality_classifier import quality_scores
from tessella.llm.quality_rules import quality_rules
from tessella.llm.secret_scan import secret_scan
from tessella.llm.simhash_dedup import simhash_classes
from tessella.llm.topk import top_k
from tessella.llm.toxicity import toxicity_scores
from tessella.llm.url_filters import url_filter


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _read(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    scores = quality_scores(_read(spark, sf_dir, "documents"), labels)
    return scores.select("doc_id", (id_crc() % 5 == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.sql("SELECT * FROM VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow') AS r(host, path, verdict)")
    return url_filter(_read(spark, sf_dir, "pages"), rules)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = _read(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"))
    scores = toxicity_scores(_read(spark, sf_dir, "documents"), labels)
    return scores.select("doc_id", (id_crc() % 3 == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fair_mix(_read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_classes(_read(spark, sf_dir, "embeddings"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_classes(_read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan(_read(spark, sf_dir, "documents"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_read(spark, sf_dir, "documents"))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(_read(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_removed")



def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    changed = F.when(id_crc() % 7 == 0, document_digest(F.col("n_chars") + 1))
    manifest = build_manifest(_read(spark, sf_dir, "documents"), {"changed": changed})
    folded = fold(F.coalesce("changed", "leaf"), F.col("proof"))
    out = manifest.prove().select("doc_id", "leaf", "subroot", F.lit(manifest.root).cast("string").alias("root"), proof_digest(F.col("proof")).alias("proof_sha256"), folded.alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))



def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(_read(spark, sf_dir, "documents"))



def op13_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


QUERIES = {f.__name__: f for f in (op1_quality_rules, op2_quality_classifier, op3_url_filters, op4_toxicity, op5_source_mix, op6_embedding_dedup, op7_simhash, op8_secret_scan, op9_packing, op10_line_dedup, op11_merkle_manifest, op12_tokenizer_alignment, op13_exact_top_k)}
