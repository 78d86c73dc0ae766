"""Sentiment from a rated word list and from keyword rules."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postsift.defaults import BRANDS, NEGATIVE_WORDS, POSITIVE_WORDS, SENTIMENTS
from postsift.functions.matching import any_match
from postsift.functions.text import let, tokens
from postsift.storage import written

from .keywords import keyword_pairs, with_any_match
from .skew import spread_join
from .term_join import text_key
from .terms import Terms, as_column

UNSCORED = ("negative", "drop", "neutral")

#: A rated list of up to this many words is looked up inside the scan stage.
INLINE_WORDS = 10_000

#: A larger one is sent to the executors up to this size.
LOOKUP_BYTES = 32 * 1024 * 1024


def unique_words(lexicon: DataFrame) -> DataFrame:
    """The lexicon itself, after a check that no word is rated twice."""
    twice = lexicon.groupBy("word").count().where(F.col("count") > 1).select("word").take(3)
    if twice:
        names = ", ".join(row["word"] for row in twice)
        raise ValueError(f"rated more than once: {names}")
    return lexicon


def _inline_ratings(rated: DataFrame) -> dict[int, list[str]] | None:
    """Words by rating, or None when the list cannot be looked up inside the scan stage."""
    if not isinstance(rated.schema["total"].dataType, T.IntegralType):
        return None
    size = rated.agg(
        F.count("*").alias("rows"),
        F.coalesce(F.max(F.length("word")), F.lit(0)).alias("longest"),
        F.coalesce(F.max("times"), F.lit(1)).alias("times"),
    ).first()
    if size["rows"] > INLINE_WORDS or size["longest"] > 200 or size["times"] > 1:
        return None
    by_rating: dict[int, list[str]] = {}
    for row in rated.collect():
        by_rating.setdefault(row["total"], []).append(row["word"])
    if len(by_rating) > 50 or any("\\" in word for words in by_rating.values() for word in words):
        return None
    return {rating: sorted(words) for rating, words in sorted(by_rating.items())}


def _quoted(words: Sequence[str]) -> str:
    return ", ".join("'" + word.replace("'", "\\'") + "'" for word in words)


def _mean_rating(words: str, by_rating: dict[int, list[str]]) -> Column:
    """Mean rating of the rated words in an array column, NULL without any.

    Each lookup is a hash probe, as lists of constants are. The lists are written as SQL
    text, because thousands of literals take seconds to set up one by one.
    """
    if not by_rating:
        return F.lit(None).cast("double")
    known = _quoted([word for listed in by_rating.values() for word in listed])
    cases = " ".join(
        f"WHEN word IN ({_quoted(listed)}) THEN {rating}L" for rating, listed in by_rating.items()
    )
    ratings = F.expr(
        f"transform(filter({words}, word -> word IN ({known})), word -> CASE {cases} END)"
    )
    return let(
        ratings,
        lambda found: F.when(
            F.size(found) > 0,
            F.aggregate(found, F.lit(0).cast("bigint"), lambda total, value: total + value)
            / F.size(found),
        ),
    )


def _repeats(df: DataFrame, key: str) -> bool:
    return not df.groupBy(key).count().where(F.col("count") > 1).isEmpty()


def lexicon_score(
    df: DataFrame,
    lexicon: DataFrame,
    id: str = "id",
    text: str = "content",
    tokenizer: str = "whitespace",
    unique_ids: bool | None = None,
) -> DataFrame:
    """``tweet_id, tweet_content, tweet_rating``: mean rating of the rated words of a post.

    The score depends on the text alone, so it is computed inside the row; the
    result has one row per different (id, content), so equal rows have to be dropped only
    if an id repeats. ``unique_ids`` says so beforehand; None looks it up by reading the
    id column alone. A post without text, or without any token, gives no row.
    """
    posts = df.select(F.col(id).alias("tweet_id"), F.col(text).alias("tweet_content"))
    words = tokens(F.col("tweet_content"), tokenizer)
    rated = _rated(lexicon)
    by_rating = _inline_ratings(rated)
    looked_up = _lookup(rated) if by_rating is None else None
    if by_rating is None and looked_up is None:
        return _score_by_join(posts, rated, words, unique_ids)
    if unique_ids is None:
        unique_ids = not _repeats(posts, "tweet_id")
    if not unique_ids:
        posts = posts.distinct()
    if tokenizer == "whitespace":
        posts = posts.where(F.col("tweet_content").isNotNull())
    else:
        posts = posts.where(F.size(words) > 0)
    if looked_up is not None:
        return posts.withColumn("tweet_rating", looked_up(words))
    scored = posts.withColumn("__words", words)
    return scored.withColumn("tweet_rating", _mean_rating("__words", by_rating)).drop("__words")


def _rated(lexicon: DataFrame) -> DataFrame:
    """``word, total, times``: the sum and the number of a word's ratings, written once.

    Ratings keep their type: whole numbers are summed exactly.
    """
    whole = isinstance(lexicon.schema["rating"].dataType, T.IntegralType)
    rated = lexicon.where(F.col("word").isNotNull() & F.col("rating").isNotNull())
    rating = F.col("rating").cast("bigint" if whole else "double")
    return written(rated.groupBy("word").agg(F.sum(rating).alias("total"), F.count("*").alias("times")))


def _lookup(rated: DataFrame) -> Callable[[Column], Column] | None:
    """Mean rating of an array of words, from a table of middle size that every executor gets.

    Words are looked up a batch of texts at a time; nothing is exploded or shuffled. None for a
    table that was measured to be larger than ``LOOKUP_BYTES``.
    """
    size = rated.agg(F.coalesce(F.sum(_row_bytes()), F.lit(0)).alias("size")).first()["size"]
    if size > LOOKUP_BYTES:
        return None
    shared = _shared(rated)

    @F.arrow_udf("double")
    def mean(words: pa.Array) -> pa.Array:
        sums, found, _ = _looked_up(shared.value, words)
        return pa.array(sums / np.maximum(found, 1), mask=found == 0)

    return mean


def _row_bytes() -> Column:
    return F.octet_length("word") + F.lit(24)


def _shared(rated: DataFrame) -> Broadcast:
    return rated.sparkSession.sparkContext.broadcast(rated.toArrow().combine_chunks())


def _looked_up(known: pa.Table, words: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Per list of words the sum and number of the known ones' ratings, and the list of the others."""
    sizes = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False)
    flat = words.flatten()
    place = pc.fill_null(pc.index_in(flat, value_set=known["word"].combine_chunks()), -1).to_numpy(zero_copy_only=False)
    text_of = np.repeat(np.arange(len(words)), sizes)
    there = place >= 0
    found = np.zeros(len(words), np.int64)
    np.add.at(found, text_of[there], known["times"].to_numpy()[place[there]])
    total = known["total"].to_numpy()
    sums = np.zeros(len(words), total.dtype)
    np.add.at(sums, text_of[there], total[place[there]])
    starts = np.append(0, np.cumsum(np.bincount(text_of[~there], minlength=len(words))))
    others = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), flat.filter(pa.array(~there)).cast(pa.string()))
    return sums, found, others


def _score_by_join(
    posts: DataFrame, rated: DataFrame, words: Column, unique_ids: bool | None
) -> DataFrame:
    """The same for a lexicon of any size.

    The words that are in the texts most often are looked up inside the row, as many as fit into
    ``LOOKUP_BYTES``, rated or not; only the others are joined, without their text. So no word that
    is joined has many rows. Equal (id, content) rows share a key; adding up their words twice leaves
    the mean as it is. Only if an id repeats are whole texts compared.
    """
    if unique_ids is None:
        unique_ids = not _repeats(posts, "tweet_id")
    if not unique_ids:
        posts = posts.distinct()
    key = F.struct("tweet_id", text_key(F.col("tweet_content")).alias("text"))
    keyed = posts.where(F.col("tweet_content").isNotNull()).withColumn("__key", key)
    common, rare = _by_frequency(keyed.select(F.explode(words).alias("word")), rated)
    shared = _shared(common)
    kind = "bigint" if isinstance(rated.schema["total"].dataType, T.IntegralType) else "double"

    @F.arrow_udf(f"struct<total: {kind}, found: bigint, others: array<string>>")
    def partly(words: pa.Array) -> pa.Array:
        sums, found, others = _looked_up(shared.value, words)
        return pa.StructArray.from_arrays([pa.array(sums), pa.array(found), others], ["total", "found", "others"])

    part = written(keyed.where(F.size(words) > 0).select("__key", partly(words).alias("part")).select("__key", "part.*"))
    joined = spread_join(part.select("__key", F.explode("others").alias("word")), rare, "word", F.col("__key"))
    scores = (
        part.select("__key", "total", "found")
        .unionByName(joined.select("__key", "total", F.col("times").alias("found")))
        .groupBy("__key")
        .agg(F.sum("total").alias("total"), F.sum("found").alias("found"))
    )
    rating = F.when(F.col("found") > 0, F.col("total") / F.col("found"))
    return keyed.join(scores, "__key").select("tweet_id", "tweet_content", rating.alias("tweet_rating"))


def _by_frequency(words: DataFrame, rated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``word, total, times`` of the most frequent words, also unrated ones, and of the other rated ones."""
    counts = words.groupBy("word").agg(F.count("*").alias("n"))
    level = F.floor(4 * F.log2("n")).cast("int").alias("level")
    held = written(
        counts.join(rated, "word", "left")
        .select("word", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("times", F.lit(0)).alias("times"), level)
    )
    sizes = held.groupBy("level").agg(F.sum(_row_bytes()).alias("size")).orderBy(F.desc("level")).collect()
    least, size = None, 0
    for row in sizes:
        size += row["size"]
        if size > LOOKUP_BYTES:
            break
        least = row["level"]
    common = F.lit(False) if least is None else F.col("level") >= least
    table = held.select("word", "total", "times")
    return table.where(common), table.where(~common & (F.col("times") > 0))


def label(rating: Column, unscored: str = "negative") -> Column:
    """``positive`` from 0 upwards, else ``negative``; unrated posts as chosen."""
    if unscored not in UNSCORED:
        raise ValueError(f"unknown choice for unscored posts: {unscored}")
    missing = F.lit("neutral" if unscored == "neutral" else "negative")
    if unscored == "drop":
        missing = F.lit(None).cast("string")
    return (
        F.when(rating.isNull(), missing)
        .when(rating >= 0, F.lit("positive"))
        .otherwise(F.lit("negative"))
    )


def lexicon_sentiment(
    df: DataFrame,
    lexicon: DataFrame,
    id: str = "id",
    text: str = "content",
    tokenizer: str = "whitespace",
    unscored: str = "negative",
    unique_ids: bool | None = None,
) -> DataFrame:
    """``tweet_id, tweet_content, tweet_rating, sentiment``."""
    scored = lexicon_score(df, lexicon, id, text, tokenizer, unique_ids)
    labelled = scored.withColumn("sentiment", label(F.col("tweet_rating"), unscored))
    return labelled.where(F.col("sentiment").isNotNull()) if unscored == "drop" else labelled


def rule_sentiment(
    text: Column,
    positive: Sequence[str] = POSITIVE_WORDS,
    negative: Sequence[str] = NEGATIVE_WORDS,
    match: str = "contains",
) -> Column:
    """``positive`` if a positive word occurs, else ``negative`` if a negative one does.

    Words are also found inside longer words ("hate" in "whatever") except by ``word``.
    """
    return (
        F.when(any_match(text, positive, match), F.lit(SENTIMENTS[0]))
        .when(any_match(text, negative, match), F.lit(SENTIMENTS[1]))
        .otherwise(F.lit(SENTIMENTS[2]))
    )


def with_rule_sentiment(
    df: DataFrame,
    positive: Terms = POSITIVE_WORDS,
    negative: Terms = NEGATIVE_WORDS,
    text: str = "content",
    match: str = "contains",
    name: str = "sentiment",
) -> DataFrame:
    """Add ``rule_sentiment``, the words being lists or relations of any size.

    Whether a word occurs is all that is asked of a relation, so no pairs are listed.
    """
    if not isinstance(positive, DataFrame) and not isinstance(negative, DataFrame):
        return df.withColumn(name, rule_sentiment(F.col(text), positive, negative, match))
    marked = with_any_match(df, positive, "__positive", text, match)
    marked = with_any_match(marked, negative, "__negative", text, match)
    mood = (
        F.when(F.col("__positive"), F.lit(SENTIMENTS[0]))
        .when(F.col("__negative"), F.lit(SENTIMENTS[1]))
        .otherwise(F.lit(SENTIMENTS[2]))
    )
    return marked.select(*df.columns, mood.alias(name))


def brand_sentiment(
    df: DataFrame,
    brands: Terms = BRANDS,
    positive: Terms = POSITIVE_WORDS,
    negative: Terms = NEGATIVE_WORDS,
    text: str = "content",
    zero_fill: bool = True,
    match: str = "contains",
) -> DataFrame:
    """``restaurant, sentiment, count``: posts per brand and rule sentiment, sorted.

    With ``zero_fill`` every brand has a row for each sentiment: the combinations are added
    as rows that count nothing, which needs no outer join.
    """
    mentions = keyword_pairs(df.select(text), brands, text, keyword="restaurant")
    judged = with_rule_sentiment(mentions, positive, negative, text, match)
    ones = judged.select("restaurant", "sentiment", F.lit(1).cast("bigint").alias("n"))
    if zero_fill:
        ones = ones.unionByName(_combinations(df, brands))
    counts = ones.groupBy("restaurant", "sentiment").agg(F.sum("n").alias("count"))
    return counts.orderBy("restaurant", "sentiment")


def _combinations(df: DataFrame, brands: Terms) -> DataFrame:
    if isinstance(brands, DataFrame):
        names = as_column(brands).select(F.col("term").alias("restaurant")).distinct()
    else:
        names = df.sparkSession.createDataFrame([(name,) for name in brands], "restaurant string")
    every = F.explode(F.array(*[F.lit(name) for name in SENTIMENTS])).alias("sentiment")
    return names.select("restaurant", every, F.lit(0).cast("bigint").alias("n"))
