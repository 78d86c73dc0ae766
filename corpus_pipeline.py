"""From raw documents to training tokens: five stages over whole tables.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and read again as
the next stage's documents. All but the last return the columns of documents, whatever further ones
there are and whatever their names. Null and empty texts are documents without words; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postsift.llm import op03_minhash_dedup, op05_quality_classifier, op06_decontamination, op09_secret_scans
from postsift.llm.common import bucket_of, documents, labels, unused, whole
from postsift.llm.op07_byte_bpe import encode_decode
from postsift.llm.queries import byte_pairs
from postsift.storage import written

# Documents that score lower are rejected.
LEAST_QUALITY = 0.3


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on four fifths of the labelled ones, takes for good.

    Every row is judged by its own text alone: rows that repeat an id or have none, and empty texts,
    are scored like all others. A score equal to the limit is enough.
    """
    known = labels(spark, sf_dir).where(bucket_of("doc_id", 5) != 0)
    model = op05_quality_classifier.fit_quality(docs, known.select("doc_id", F.col("quality").alias("label")))
    return docs.where(op05_quality_classifier.quality_score(model, F.col("text")) >= LEAST_QUALITY)


def minhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of near-duplicates, that of the smallest doc_id.

    Rows that repeat id and text are reduced to one; rows without an id stay.
    """
    found = op03_minhash_dedup.near_duplicates(docs, words=5)
    key = unused("text_key", docs)
    gone = found.where("NOT kept").select("doc_id").distinct()
    keyed = docs.join(gone, "doc_id", "left_anti").withColumn(key, F.xxhash64(whole("text")))
    return keyed.dropDuplicates(["doc_id", key]).select(*[F.col(f"`{name}`") for name in docs.columns])


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of the benchmark.

    Every row is judged by its own text: repeated rows stay or go together, null ids don't matter,
    and texts without words hold nothing.
    """
    return op06_decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets replaced by a mark, one for secrets that overlap.

    Rows without secrets stay as they are, null texts included; repeated rows get equal texts.
    """
    return op09_secret_scans.redact(docs)


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text, and whether they decode to its bytes.

    One row per document, with or without an id. Null and empty texts have no ids.
    """
    encoded = encode_decode(docs, byte_pairs(spark), keep=["text"])
    return encoded.select(
        "doc_id", "n_tokens", "ids", (F.col("decoded") == whole("text").cast("binary")).alias("decodes")
    )


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_classifier),
    ("minhash_dedup", minhash_dedup),
    ("decontamination", decontamination),
    ("secret_scans", secret_scans),
    ("byte_bpe", byte_bpe),
]

# A learned model and near-duplicate groups have no SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
