"""Common substrings of user names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postsift.defaults import MIN_SUBSTRING, TOP_SUBSTRINGS
from postsift.storage import written

from .skew import spread_join

#: Names are searched in pieces of so many characters.
PIECE = 1_000


def distinct_names(df: DataFrame, user: str = "username") -> DataFrame:
    """``name``: different user names in lower case, without missing and empty ones."""
    names = df.select(F.lower(F.col(user)).alias("name"))
    return names.where(F.length("name") > 0).distinct()


def substring_counts(
    df: DataFrame, user: str = "username", min_len: int = MIN_SUBSTRING
) -> DataFrame:
    """``substring, count`` over all substrings of at least ``min_len`` characters.

    A substring that occurs twice in a name counts twice. Starts and lengths are exploded
    one after the other, so that a long name is never held as one array of substrings.
    """
    names = distinct_names(df, user).where(F.length("name") >= min_len)
    starts = names.select(
        "name",
        F.explode(F.sequence(F.lit(1), F.length("name") - (min_len - 1))).alias("start"),
    )
    cuts = starts.select(
        "name",
        "start",
        F.explode(F.sequence(F.lit(min_len), F.length("name") - F.col("start") + 1)).alias("size"),
    )
    parts = cuts.select(F.substring("name", F.col("start"), F.col("size")).alias("substring"))
    return parts.groupBy("substring").agg(F.count("*").alias("count"))


def _tails(names: DataFrame, min_len: int, width: int) -> DataFrame:
    """``gram, tail``: from every start in a name, the first ``min_len`` and ``width`` characters.

    Names are cut into overlapping pieces first: finding a place takes time in proportion to it.
    """
    at = F.sequence(F.lit(1), F.length("name"), F.lit(PIECE))
    pieces = names.select(F.explode(F.transform(
        at, lambda start: F.substring("name", start, F.lit(PIECE + width - 1))
    )).alias("piece")).where(F.length("piece") >= min_len)
    last = F.least(F.lit(PIECE), F.length("piece") - (min_len - 1))
    starts = pieces.select("piece", F.explode(F.sequence(F.lit(1), last)).alias("start"))
    return starts.select(F.substring("piece", F.col("start"), F.lit(width)).alias("tail")).select(
        F.substring("tail", 1, min_len).alias("gram"), "tail"
    )


def common_substrings(
    df: DataFrame,
    user: str = "username",
    min_len: int = MIN_SUBSTRING,
    top: int = TOP_SUBSTRINGS,
) -> DataFrame:
    """The ``top`` most common substrings, ties by substring.

    The beginnings of a substring are at least as common and come before it in a tie. So one of
    the first ``top`` is less than ``top`` characters longer than ``min_len``, and it begins with
    one of the shortest substrings that are as common as the ``top``-th of these. Only the latter
    are lengthened; rows grow with the length of a name, not with its square.
    """
    names = distinct_names(df, user).where(F.length("name") >= min_len)
    tails = _tails(names, min_len, min_len + top - 1)
    grams = written(tails.groupBy("gram").agg(F.count("*").alias("count")))
    best = grams.orderBy(F.desc("count")).limit(top).agg(F.min("count").alias("least"), F.count("*").alias("n")).first()
    least = best["least"] if best["n"] == top else 0
    begun = grams.where(F.col("count") >= least)
    longer = spread_join(tails, begun.select("gram"), "gram", F.col("tail")).where(F.length("tail") > min_len)
    sizes = F.sequence(F.lit(min_len + 1), F.length("tail"))
    lengthened = longer.select("tail", F.explode(sizes).alias("size")).select(
        F.substring("tail", F.lit(1), F.col("size")).alias("substring")
    )
    counts = lengthened.groupBy("substring").agg(F.count("*").alias("count"))
    every = begun.select(F.col("gram").alias("substring"), "count").unionByName(counts)
    return every.orderBy(F.desc("count"), F.asc("substring")).limit(top)
