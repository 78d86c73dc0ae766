"""One query per operator over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    op01_toxicity,
    op02_sentence_spans,
    op03_minhash_dedup,
    op04_suffix_dedup,
    op05_quality_classifier,
    op06_decontamination,
    op07_byte_bpe,
    op08_warc,
    op09_secret_scans,
    op10_quality_rules,
    op11_merkle_manifest,
    op12_pii_crf,
    op13_periodic_runs,
)
from .common import bucket_of, documents, labels

Query = Callable[[SparkSession, str], DataFrame]


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    known = labels(spark, sf_dir).where(bucket_of("doc_id", 3) != 1)
    model = op01_toxicity.fit_toxicity(docs, known.select("doc_id", F.col("toxic").alias("label")))
    scored = docs.select("doc_id", op01_toxicity.toxicity_score(model, F.col("text")).alias("found"))
    return scored.select(
        "doc_id", (bucket_of("doc_id", 3) == 1).alias("held_out"), F.col("found.score").alias("score"),
        (F.col("found.score") >= 0.7).cast("int").alias("predicted"), F.col("found.evidence").alias("evidence"),
    )


def op2_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op02_sentence_spans.remove_repeated_sentences(documents(spark, sf_dir))


def op3_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op03_minhash_dedup.near_duplicates(documents(spark, sf_dir), words=2)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op04_suffix_dedup.remove_repeated_bytes(documents(spark, sf_dir))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    known = labels(spark, sf_dir).where(bucket_of("doc_id", 5) != 0)
    model = op05_quality_classifier.fit_quality(docs, known.select("doc_id", F.col("quality").alias("label")))
    scored = docs.select("doc_id", op05_quality_classifier.quality_score(model, F.col("text")).alias("score"))
    return scored.select(
        "doc_id", (bucket_of("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return op06_decontamination.containment(documents(spark, sf_dir), items)


def byte_pairs(spark: SparkSession) -> op07_byte_bpe.BytePairs:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return op07_byte_bpe.BytePairs(spark, path, public_tokenizers.PATTERN)


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op07_byte_bpe.encode_decode(documents(spark, sf_dir), byte_pairs(spark)).select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = op08_warc.round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    measured = records.select(
        "page_id",
        F.coalesce(F.octet_length("payload"), "payload_bytes").cast("bigint").alias("payload_bytes"),
        F.coalesce(F.sha2("payload", 256), "payload_digest").alias("payload_digest"),
        "record_type",
        "refers_to",
    )
    return measured


_WARC_SQL = """
WITH digested AS (
    SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes,
        sha256(coalesce(html, '')) AS payload_digest FROM pages
),
firsts AS (
    SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first
    FROM digested
)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
    CASE WHEN first < page_id THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN first < page_id THEN first END AS refers_to
FROM firsts
"""


def op9_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op09_secret_scans.scan_secrets(documents(spark, sf_dir)).drop("owned", "base", "row_key")


def op10_quality_rules_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    trusted = labels(spark, sf_dir).where("quality = 1 AND toxic = 0")
    ratios = op10_quality_rules.ratio_table(docs, trusted)
    return op10_quality_rules.quality_rules(docs, ratios)


def op11_merkle_manifest_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    proven = op11_merkle_manifest.verify_rows(documents(spark, sf_dir), bucket_of("doc_id", 3) == 0)
    return proven.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def op12_pii_crf_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op12_pii_crf.find_personal_data(documents(spark, sf_dir)).drop("base", "added")


def op13_periodic_runs_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    number = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    found = op13_periodic_runs.periodic_runs(docs, text=op13_periodic_runs.looped(F.col("text"), number))
    return op13_periodic_runs.digests(found)


def queries() -> dict[str, Query]:
    return {
        "op1_toxicity": op1_toxicity,
        "op2_sentence_spans": op2_sentence_spans,
        "op3_minhash_dedup": op3_minhash_dedup,
        "op4_suffix_dedup": op4_suffix_dedup,
        "op5_quality_classifier": op5_quality_classifier,
        "op6_decontamination": op6_decontamination,
        "op7_byte_bpe": op7_byte_bpe,
        "op8_warc": op8_warc,
        "op9_secret_scans": op9_secret_scans,
        "op10_quality_rules": op10_quality_rules_query,
        "op11_merkle_manifest": op11_merkle_manifest_query,
        "op12_pii_crf": op12_pii_crf_query,
        "op13_periodic_runs": op13_periodic_runs_query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_sentence_spans": op02_sentence_spans.SQL,
        "op3_minhash_dedup": op03_minhash_dedup.SQL,
        "op6_decontamination": op06_decontamination.SQL,
        "op8_warc": _WARC_SQL,
        "op9_secret_scans": op09_secret_scans.sql(),
        "op10_quality_rules": op10_quality_rules.sql(),
        "op11_merkle_manifest": op11_merkle_manifest.sql(),
    }
