"""The nine jobs from input files to output folders.

Each reads JSON lines, writes below ``out`` and returns nothing. Options are those of the
operators. A count of matches is taken from the matches just written, so the posts are
searched once for both.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from postsift import sinks
from postsift.defaults import (
    ANTI_LABEL,
    BRANDS,
    COUNTRY,
    NEGATIVE_WORDS,
    POSITIVE_WORDS,
    PRO_LABEL,
)
from postsift.operators import brands as brand_ops
from postsift.operators import keywords as keyword_ops
from postsift.operators import names as name_ops
from postsift.operators import places as place_ops
from postsift.operators import sentiment as sentiment_ops
from postsift.operators import topics as topic_ops
from postsift.operators.terms import Terms
from postsift.schemas import POST_COLUMNS
from postsift.sources import (
    flatten_tweets,
    read_keywords,
    read_lexicon,
    read_lines,
    read_names,
    read_tweets,
)


def _posts(spark: SparkSession, tweets: str, on_error: str):
    return flatten_tweets(read_tweets(spark, tweets, on_error))


def censor_job(
    spark: SparkSession,
    tweets: str,
    keywords: str,
    out: str,
    remainder: str = "except",
    match: str = "contains",
    fold_keyword: bool = True,
    on_error: str = "drop",
) -> None:
    """Matching posts to ``matches``, their number to ``count``, the rest to ``kept``."""
    posts = _posts(spark, tweets, on_error).select(*POST_COLUMNS)
    parts = keyword_ops.censor(
        posts,
        read_keywords(spark, keywords),
        remainder,
        match=match,
        fold_keyword=fold_keyword,
    )
    sinks.write_json(parts.matches, f"{out}/matches")
    sinks.write_count(read_lines(spark, f"{out}/matches"), f"{out}/count")
    sinks.write_json(parts.kept, f"{out}/kept")


def state_job(
    spark: SparkSession,
    tweets: str,
    keywords: str,
    out: str,
    country: str = COUNTRY,
    state: str = "second",
    count: str = "tweets",
    match: str = "contains",
    fold_keyword: bool = True,
    group_size: int = 10_000,
    on_error: str = "drop",
) -> None:
    """Matching posts nested below their state, states with most posts first."""
    groups = place_ops.state_groups(
        _posts(spark, tweets, on_error),
        read_keywords(spark, keywords),
        country,
        state,
        count,
        match,
        fold_keyword,
        group_size,
    )
    sinks.write_json(groups, out)


def stance_job(
    spark: SparkSession,
    tweets: str,
    pro: str,
    anti: str,
    out: str,
    match: str = "contains",
    fold_keyword: bool = True,
    on_error: str = "drop",
) -> None:
    """Matches of both lists with their keyword, totals, and users ranked by each list.

    The posts are read once. Totals and rankings are read off the matches just written,
    which are few next to the posts.
    """
    posts = _posts(spark, tweets, on_error).select(*POST_COLUMNS)
    pairs = keyword_ops.stance_pairs(
        posts,
        read_keywords(spark, pro),
        read_keywords(spark, anti),
        match=match,
        fold_keyword=fold_keyword,
    )
    sinks.write_split(pairs, f"{out}/matches", "tipo", "json", "errorifexists")
    written = spark.read.schema(pairs.schema).json(f"{out}/matches")
    labels = spark.createDataFrame(
        [(label, 0) for label in (PRO_LABEL, ANTI_LABEL)], "tipo string, n bigint"
    )
    ones = written.select("tipo", F.lit(1).cast("bigint").alias("n"))
    totals = ones.unionByName(labels).groupBy("tipo").agg(F.sum("n").alias("numero"))
    sinks.write_json(totals.orderBy("tipo"), f"{out}/totals")
    for side, label in (("pro", PRO_LABEL), ("anti", ANTI_LABEL)):
        users = written.where(F.col("tipo") == label).groupBy("username")
        counts = users.agg(F.count("*").alias("count"))
        ranked = counts.orderBy(F.desc("count"), F.asc("username"))
        sinks.write_json(ranked, f"{out}/users_{side}")


def trend_job(spark: SparkSession, tweets: str, names: str, out: str) -> None:
    """Brands found in raw lines, as a fixed-width report."""
    trend = brand_ops.brand_trend(read_lines(spark, tweets), read_names(spark, names))
    sinks.write_report(trend, out, ["restaurant"])


def location_job(
    spark: SparkSession, tweets: str, names: str, out: str, on_error: str = "drop"
) -> None:
    """Brands by user location, as a fixed-width report."""
    counts = brand_ops.brand_by_location(
        _posts(spark, tweets, on_error), read_names(spark, names)
    )
    sinks.write_report(counts, out, ["restaurant", "location"])


def substring_job(
    spark: SparkSession,
    tweets: str,
    out: str,
    min_len: int = 5,
    top: int = 100,
    on_error: str = "drop",
) -> None:
    """The most common substrings of user names, ``substring<TAB>count``."""
    best = name_ops.common_substrings(
        _posts(spark, tweets, on_error), "username", min_len, top
    )
    sinks.write_ranked(best, out, "substring")


def lexicon_job(
    spark: SparkSession,
    tweets: str,
    lexicon: str,
    out: str,
    tokenizer: str = "whitespace",
    unscored: str = "negative",
    limit: int | None = None,
    on_error: str = "drop",
) -> None:
    """Scored posts, ``out/sentiment=positive`` and ``out/sentiment=negative``."""
    posts = _posts(spark, tweets, on_error).select("id", "content")
    if limit is not None:
        posts = posts.orderBy("id", "content").limit(limit)
    scored = sentiment_ops.lexicon_sentiment(
        posts, read_lexicon(spark, lexicon), tokenizer=tokenizer, unscored=unscored
    )
    sinks.write_split(scored, out, "sentiment")


def brand_sentiment_job(
    spark: SparkSession,
    tweets: str,
    out: str,
    brands: Terms = BRANDS,
    positive: list[str] = POSITIVE_WORDS,
    negative: list[str] = NEGATIVE_WORDS,
    zero_fill: bool = True,
    on_error: str = "drop",
) -> None:
    """Posts per brand and sentiment, as CSV with a header."""
    counts = sentiment_ops.brand_sentiment(
        _posts(spark, tweets, on_error), brands, positive, negative, zero_fill=zero_fill
    )
    sinks.write_csv(counts, out)


def topic_job(
    spark: SparkSession,
    tweets: str,
    out: str,
    model_path: str | None = None,
    k: int = 20,
    drop_empty: bool = True,
    on_error: str = "drop",
    stop: Sequence[str] | None = None,
    **fit_options,
) -> None:
    """Posts per topic, ``topic words<TAB>count``; the model is saved if a path is given."""
    posts = _posts(spark, tweets, on_error).select("id", "content")
    model = topic_ops.fit_topics(posts, k=k, stop=stop, **fit_options)
    if model_path is not None:
        topic_ops.save_topics(model, model_path)
    sinks.write_ranked(
        topic_ops.topic_counts(posts, model, drop_empty=drop_empty, stop=stop), out, "topic_words"
    )
