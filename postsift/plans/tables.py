"""The given tables as inputs of the queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as it is, spread over the cores if its file gives fewer tasks than that.

    A file of one row group is one task however many cores there are. On inputs with more
    splits than cores, which is the normal case, nothing is moved.
    """
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores, df.columns[0])


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as flat posts."""
    key = F.col("doc_id")
    city = F.concat(F.lit("City"), (key % 11).cast("string"), F.lit(", "), F.col("source"))
    return table(spark, sf_dir, "documents").select(
        key.alias("id"),
        F.col("text").alias("content"),
        F.col("source").alias("username"),
        F.when(key % 9 != 0, F.upper("lang")).alias("location"),
        F.col("n_chars").alias("likeCount"),
        (key % 7).alias("retweetCount"),
        F.when(F.col("lang") == "en", F.lit("United States")).otherwise(F.col("lang")).alias("country"),
        F.when(key % 5 == 0, F.col("source")).otherwise(city).alias("fullName"),
    )


def nested(flat: DataFrame) -> DataFrame:
    """Flat posts as records of the tweet schema."""
    return flat.select(
        "id",
        "content",
        "likeCount",
        "retweetCount",
        F.struct("username", "location").alias("user"),
        F.struct("country", "fullName").alias("place"),
    )
