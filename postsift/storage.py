"""Intermediate tables in the folder all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postsift.defaults import BROADCAST_BYTES


def fresh_folder(spark: SparkSession) -> str:
    """A new folder name below ``spark.checkpoint.dir``, which a cluster has to set.

    Only a session that runs in one process, as in tests, gets a temporary folder without it.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        master = spark.conf.get("spark.master", "")
        if not master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors see")
        shared = tempfile.mkdtemp(prefix="postsift-")
    return f"{shared.rstrip('/')}/postsift-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """The same rows, computed once and read from a table.

    Its size is known to the planner, and a lost executor costs no recomputation.
    """
    spark = df.sparkSession
    folder = fresh_folder(spark)
    df.write.parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def fits_in_memory(df: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    """Whether a table of strings is small enough to be copied to every executor."""
    text = [F.octet_length(F.col(name).cast("string")) for name in df.columns]
    width = sum((F.coalesce(size, F.lit(0)) + F.lit(32) for size in text), F.lit(0))
    size = df.agg(F.coalesce(F.sum(width.cast("bigint")), F.lit(0)).alias("size")).first()
    return size["size"] <= limit
