"""Matching posts grouped by state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from postsift.defaults import COUNTRY
from postsift.functions.text import state_of
from postsift.schemas import POST_COLUMNS

from .keywords import censor
from .skew import every_salt, salt_of
from .term_join import text_key
from .terms import Terms

COUNTS = ("tweets", "pairs")

#: So many counts of groups travel inside the plan.
FEW_GROUPS = 10_000


def state_matches(
    df: DataFrame,
    keywords: Terms,
    country: str | None = COUNTRY,
    state: str = "second",
    count: str = "tweets",
    match: str = "contains",
    fold_keyword: bool = True,
) -> DataFrame:
    """Matching posts of one country with their state, not yet grouped.

    With ``count="pairs"`` a post is listed once per keyword, with ``"tweets"`` once.
    """
    if count not in COUNTS:
        raise ValueError(f"unknown count: {count}")
    if country is not None:
        df = df.where(F.col("country") == country)
    found = censor(df, keywords, "anti", count, "content", match, fold_keyword).matches
    return found.withColumn("state", state_of(F.col("fullName"), state))


def _short_row() -> list[Column]:
    """A post's columns with the text replaced by its key, which is enough to compare."""
    return [
        text_key(F.col(name)).alias(name) if name == "content" else F.col(name)
        for name in POST_COLUMNS
    ]


def state_counts(
    df: DataFrame,
    keywords: Terms,
    country: str | None = COUNTRY,
    state: str = "second",
    count: str = "tweets",
    match: str = "contains",
    fold_keyword: bool = True,
) -> DataFrame:
    """``state, cantidad_tweets``, most first.

    ``tweets`` counts different (content, username, likeCount, retweetCount) rows. Only the
    32 byte key of a text is shuffled for it, and no group is ever gathered in one place.
    """
    found = state_matches(df, keywords, country, state, count, match, fold_keyword)
    return _counts(found, count).orderBy(
        F.desc("cantidad_tweets"), F.asc_nulls_last("state")
    )


def _counts(found: DataFrame, count: str) -> DataFrame:
    if count == "tweets":
        found = found.select("state", *_short_row()).distinct()
    return found.groupBy("state").agg(F.count("*").alias("cantidad_tweets"))


def _members(found: DataFrame, count: str, extra: tuple[str, ...]) -> DataFrame:
    rows = found.select("state", *POST_COLUMNS, *extra)
    return rows.distinct() if count == "tweets" else rows


def with_group_count(
    df: DataFrame, key: str, name: str, counts: DataFrame | None = None
) -> DataFrame:
    """Add to every row the number of rows that share its key; NULL is a key too.

    A window would bring a whole group into one task. Here the groups are counted first.
    Up to ``FEW_GROUPS`` of them are copied to the rows; beyond that the rows of a group
    are spread over several partitions to meet its count.
    ``counts`` (key, name) may be given where there is a cheaper way to get them.
    """
    if counts is None:
        counts = df.groupBy(key).agg(F.count("*").alias(name))
    counts = counts.select(F.col(key).alias("__key"), name)
    few = counts.limit(FEW_GROUPS + 1).collect()
    if len(few) <= FEW_GROUPS:
        counts = df.sparkSession.createDataFrame(few, counts.schema)
        joined = df.join(F.broadcast(counts), F.col(key).eqNullSafe(F.col("__key")))
        return joined.drop("__key")
    salted = df.withColumn("__salt", salt_of(*[F.col(column) for column in df.columns]))
    copied = counts.select("*", every_salt().alias("__part"))
    same = F.col(key).eqNullSafe(F.col("__key")) & (F.col("__salt") == F.col("__part"))
    return salted.join(copied, same).drop("__key", "__salt", "__part")


def state_members(
    df: DataFrame,
    keywords: Terms,
    country: str | None = COUNTRY,
    state: str = "second",
    count: str = "tweets",
    match: str = "contains",
    fold_keyword: bool = True,
    extra: tuple[str, ...] = (),
) -> DataFrame:
    """``state, cantidad_tweets`` and the post's columns: one row per post, flat.

    This is the form to use on large data: a state may hold any number of posts.
    """
    found = state_matches(df, keywords, country, state, count, match, fold_keyword)
    counts = None if extra else _counts(found, count)
    rows = with_group_count(_members(found, count, extra), "state", "cantidad_tweets", counts)
    return rows.select("state", "cantidad_tweets", *POST_COLUMNS, *extra)


def state_groups(
    df: DataFrame,
    keywords: Terms,
    country: str | None = COUNTRY,
    state: str = "second",
    count: str = "tweets",
    match: str = "contains",
    fold_keyword: bool = True,
    group_size: int = 10_000,
    extra: tuple[str, ...] = (),
) -> DataFrame:
    """``state, cantidad_tweets, part, tweets``: posts nested below their state.

    A state of up to ``group_size`` posts is one row. A larger one is several rows, all
    with the state's whole count, so that no array grows with the data; together they hold
    every post. Posts are dealt to the rows by a hash.
    """
    found = state_matches(df, keywords, country, state, count, match, fold_keyword)
    rows = found.select("state", *POST_COLUMNS, *extra)
    names = rows.columns
    if count == "pairs":
        # Equal rows are counted and numbered anew, so a lost task deals them as before.
        counted = rows.groupBy(*names).agg(F.count("*").alias("__copies"))
        numbered = F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("__copies"))).alias("__copy")
        rows = counted.select(*names, numbered)
        counts = _counts(found, count)
    else:
        counts = _counts(found, count) if not extra else rows.distinct().groupBy("state").agg(F.count("*").alias("cantidad_tweets"))
    few = counts.limit(FEW_GROUPS + 1).collect()
    post = F.struct(*[F.col(name) for name in (*POST_COLUMNS, *extra)])
    dealt = F.xxhash64(*[F.col(name) for name in rows.columns])
    if len(few) > FEW_GROUPS:
        distinct = rows if count == "pairs" else rows.distinct()
        joined = with_group_count(distinct, "state", "cantidad_tweets", counts)
        parts = F.ceil(F.col("cantidad_tweets") / F.lit(group_size))
        nested = joined.withColumn("part", F.pmod(dealt, parts)).groupBy("state", "cantidad_tweets", "part")
        return nested.agg(F.sort_array(F.collect_list(post)).alias("tweets")).orderBy(
            F.desc("cantidad_tweets"), F.asc_nulls_last("state"), "part"
        )
    # The places of all parts in the result are known from the counts. Texts move once, to the
    # place of their part, where equal rows meet, are nested and stay in order.
    ranked = df.sparkSession.createDataFrame(
        _first_places(few, group_size), "__state string, cantidad_tweets bigint, __parts bigint, __first bigint"
    )
    joined = rows.join(F.broadcast(ranked), F.col("state").eqNullSafe(F.col("__state")))
    placed = joined.withColumn("part", F.pmod(dealt, F.col("__parts"))).select(
        (F.col("__first") + F.col("part")).alias("__place"), "state", "cantidad_tweets", "part", *rows.columns[1:]
    )
    spread = placed.repartitionByRange("__place")
    kept = spread if count == "pairs" else spread.distinct()
    nested = kept.groupBy("__place", "state", "cantidad_tweets", "part").agg(
        F.sort_array(F.collect_list(post)).alias("tweets")
    )
    return nested.sortWithinPartitions("__place").drop("__place")


def _first_places(counts: list[Row], group_size: int) -> list[tuple[str | None, int, int, int]]:
    """(state, count, parts, place of the first part), largest state first, no state last."""
    order = sorted(counts, key=lambda row: (-row["cantidad_tweets"], row["state"] is None, (row["state"] or "").encode()))
    places, place = [], 0
    for row in order:
        parts = -(-row["cantidad_tweets"] // group_size)
        places.append((row["state"], row["cantidad_tweets"], parts, place))
        place += parts
    return places
