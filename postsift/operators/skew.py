"""Spreading the rows of one join key over several partitions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postsift.storage import fits_in_memory, written

#: A key with more than this part of an even partition's rows is spread.
PARTS = 8


#: Where all keys are spread alike, this many ways.
SALTS = 8


def salt_of(*columns: Column) -> Column:
    """The partition of a row, by a hash of what tells it from the others of its key."""
    return F.pmod(F.xxhash64(*columns), F.lit(SALTS).cast("bigint"))


def every_salt() -> Column:
    return F.explode(F.array(*[F.lit(salt).cast("bigint") for salt in range(SALTS)]))


def hot_keys(df: DataFrame, on: str) -> DataFrame:
    """``on, salts``: the keys with many rows, and over how many partitions to spread each.

    Rows are counted by key first. A key is hot beyond an eighth of what a partition gets on
    average, so there are at most eight times as many hot keys as partitions.
    """
    counts = written(df.groupBy(on).agg(F.count("*").alias("n")))
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    share = max(1, total // (PARTS * partitions))
    return counts.where(F.col("n") > share).select(on, F.ceil(F.col("n") / share).cast("int").alias("__salts"))


def spread(df: DataFrame, hot: DataFrame, on: str, by: Column) -> DataFrame:
    """Add ``__salt``: rows of a hot key are dealt by a hash of ``by``."""
    marked = df.join(F.broadcast(hot), on, "left")
    salt = F.pmod(F.xxhash64(by), F.coalesce("__salts", F.lit(1)).cast("bigint"))
    return marked.withColumn("__salt", salt).drop("__salts")


def copied(df: DataFrame, hot: DataFrame, on: str) -> DataFrame:
    """One row for every ``__salt`` of its key."""
    marked = df.join(F.broadcast(hot), on, "left")
    last = F.coalesce("__salts", F.lit(1)).cast("bigint") - 1
    return marked.withColumn("__salt", F.explode(F.sequence(F.lit(0).cast("bigint"), last))).drop("__salts")


def spread_join(left: DataFrame, right: DataFrame, on: str, by: Column) -> DataFrame:
    """Inner join where a key of ``left`` may have any number of rows.

    A ``right`` side measured to be small is copied, so that ``left`` stays where it is.
    Otherwise the rows of a key that has many are spread by ``by``, as many ways as they need, and
    the rows of ``right`` with that key are copied to each.
    """
    if fits_in_memory(right):
        return left.join(F.broadcast(right), on)
    hot = hot_keys(left, on)
    return spread(left, hot, on, by).join(copied(right, hot, on), [on, "__salt"]).drop("__salt")
