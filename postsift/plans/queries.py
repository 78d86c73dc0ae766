"""One query per operator, over the whole given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postsift import sinks, sources
from postsift.functions import clean_tokens, one_line, state_of, tokens
from postsift.operators import brands, keywords, names, places, sentiment, topics
from postsift.operators.term_join import pairs_by_words
from postsift.schemas import POST_COLUMNS
from postsift.storage import fresh_folder, written

from .tables import nested, posts, table

Query = Callable[[SparkSession, str], DataFrame]

# Term lists that occur in the given texts.
TERMS = ["hate", "err", "Lic", "the ", "great"]
WILDCARDS = ["h_te", "gre%t", "Lic", "public"]
PATTERNS = ["h.te", "lic[ae]", "great|public"]
SPACED = ["the", "Und", "des"]
WORDS = ["the", "und", "idiot", "of the"]
PRO = ["great", "Public", "lic", "und"]
ANTI = ["hate", "sad", "Err", "und"]
VIOLENT = ["hate", "err", "die", "Sad"]
BRANDS = ["err", "lic", "des"]
NAMES = [" err", "lic", "des ", "the", "lic"]
POSITIVE = ["great", "lic", "public"]
NEGATIVE = ["hate", "sad", "moron"]
RATED = {"die": -3, "ha": 2, "no": -1, "idiot": -3, "moron": -3, "great": 3, "the": 1, "und": 4}

_QUERIES: dict[str, Query] = {}


def _query(function: Query) -> Query:
    _QUERIES[function.__name__] = function
    return function


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


# Keyword matching


@_query
def keyword_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = keywords.keyword_pairs(posts(spark, sf_dir), TERMS)
    return pairs.select("id", "username", "keyword")


@_query
def keyword_pairs_raw_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = keywords.keyword_pairs(posts(spark, sf_dir), TERMS, fold_keyword=False)
    return pairs.select("id", "username", "keyword")


@_query
def keyword_like_folded(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = keywords.keyword_pairs(posts(spark, sf_dir), WILDCARDS, match="like")
    return pairs.select("id", "keyword")


@_query
def keyword_like_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = keywords.keyword_pairs(
        posts(spark, sf_dir), WILDCARDS, match="like", fold_keyword=False
    )
    return found.select("id", "keyword")


@_query
def keyword_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = posts(spark, sf_dir).withColumn("content", one_line(F.col("content")))
    return keywords.keyword_pairs(flat, PATTERNS, match="regex").select("id", "keyword")


@_query
def keyword_regex_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = keywords.keyword_pairs(posts(spark, sf_dir), PATTERNS, match="regex")
    return found.select("id", "keyword")


@_query
def keyword_spaced(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = keywords.keyword_pairs(posts(spark, sf_dir), SPACED, match="spaced")
    return found.select("id", "keyword")


@_query
def keyword_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = keywords.keyword_pairs(posts(spark, sf_dir), WORDS, match="word")
    return found.select("id", "keyword")


@_query
def keyword_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keywords.count_matches(posts(spark, sf_dir), TERMS)


@_query
def keyword_count_tweets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keywords.count_matches(posts(spark, sf_dir), TERMS, count="tweets")


def _term_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages and single words, in a table that grows with the data."""
    passages = table(spark, sf_dir, "benchmark").select(F.col("text").alias("term"))
    parts = table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("term"))
    return passages.unionByName(parts).distinct()


@_query
def keyword_table_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = keywords.keyword_pairs(posts(spark, sf_dir), _term_table(spark, sf_dir))
    return pairs.select("id", "keyword")


@_query
def keyword_join_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = posts(spark, sf_dir).select("id", "content")
    return pairs_by_words(flat, _term_table(spark, sf_dir)).select("id", "keyword")


# Censoring


@_query
def censor_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = posts(spark, sf_dir).select(*POST_COLUMNS)
    return keywords.censor(flat, TERMS).matches


@_query
def censor_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = posts(spark, sf_dir).select(*POST_COLUMNS)
    return keywords.censor(flat, ["err", "lic"], "except").kept


@_query
def censor_except_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keywords.censor(posts(spark, sf_dir).select("content"), ["err"], "except").kept


@_query
def censor_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = posts(spark, sf_dir).withColumn("content", one_line(F.col("content")))
    kept = keywords.censor(flat, SPACED, "anti", match="spaced").kept
    return kept.select(*POST_COLUMNS)


@_query
def labelled_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "id")
    joined = posts(spark, sf_dir).select("id", "username").join(labels, "id")
    return joined.select("id", "username", "quality", "toxic")


@_query
def unlabelled_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"))
    return posts(spark, sf_dir).select("id", "username").join(labels, "id", "left_anti")


# Stances


@_query
def stance_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keywords.stance_pairs(posts(spark, sf_dir), PRO, ANTI).select("id", "tipo", "keyword")


@_query
def stance_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keywords.stance_totals(posts(spark, sf_dir), PRO, ANTI)


@_query
def stance_totals_tweets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keywords.stance_totals(posts(spark, sf_dir), PRO, ANTI, count="tweets")


@_query
def stance_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = keywords.stance_overlap(posts(spark, sf_dir), PRO, ANTI)
    return marked.select("id", "pro", "anti", "overlap")


def _long_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """More terms than travel inside a plan, each of one of two sides."""

    def part(name: str, term: str, key: str) -> DataFrame:
        return table(spark, sf_dir, name).select(F.expr(term).alias("keyword"), (F.col(key) % 2).alias("side"))

    rows = [("idiot", 0), ("clown ", 1), ("license", 0), ("Scum", 1)]
    listed = spark.createDataFrame(rows, "keyword string, side bigint")
    for name, term, key in (
        ("part", "concat(p_name, ' ', p_partkey)", "p_partkey"),
        ("customer", "c_name", "c_custkey"),
        ("benchmark", "text", "item_id"),
    ):
        listed = listed.unionByName(part(name, term, key))
    return listed


@_query
def stance_overlap_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = _long_table(spark, sf_dir)
    pro, anti = listed.where("side = 0").drop("side"), listed.where("side = 1").drop("side")
    marked = keywords.stance_overlap(posts(spark, sf_dir), pro, anti)
    return marked.select("id", "pro", "anti", "overlap")


@_query
def censor_table_except(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = posts(spark, sf_dir).select(*POST_COLUMNS)
    return keywords.censor(rows, _long_table(spark, sf_dir)).kept


@_query
def censor_table_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keywords.censor(posts(spark, sf_dir), _long_table(spark, sf_dir), "anti").kept.select("id")


@_query
def stance_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keywords.rank_users(posts(spark, sf_dir), PRO)


@_query
def stance_users_tweets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keywords.rank_users(posts(spark, sf_dir), ANTI, count="tweets")


# States


@_query
def state_counts_tweets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return places.state_counts(posts(spark, sf_dir), VIOLENT)


@_query
def state_counts_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return places.state_counts(
        posts(spark, sf_dir), VIOLENT, state="after_comma", count="pairs", fold_keyword=False
    )


@_query
def state_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = F.concat("fullName", F.lit(", "), "country")
    return posts(spark, sf_dir).select(
        "id",
        state_of(F.col("fullName")).alias("second"),
        state_of(place).alias("second_of_three"),
        state_of(F.col("fullName"), "after_comma").alias("after_comma"),
        state_of(place, "after_comma").alias("after_comma_of_three"),
    )


@_query
def state_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return places.state_members(posts(spark, sf_dir), VIOLENT)


@_query
def state_members_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = places.state_members(
        posts(spark, sf_dir), VIOLENT, country=None, count="pairs", extra=("id",)
    )
    return members.select("state", "cantidad_tweets", "id", "username")


@_query
def state_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = places.state_groups(posts(spark, sf_dir), VIOLENT, count="pairs", group_size=20)
    return groups.select("state", "cantidad_tweets", F.inline("tweets"))


@_query
def state_groups_tweets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nested form by default: one entry per different post."""
    groups = places.state_groups(posts(spark, sf_dir), VIOLENT)
    return groups.select("state", "cantidad_tweets", F.inline("tweets"))


@_query
def state_count_on_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = posts(spark, sf_dir).select("id", state_of(F.col("fullName")).alias("state"))
    return places.with_group_count(rows, "state", "tweet_count")


# Sentiment


def _rated(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(RATED.items()), "word string, rating int")


@_query
def lexicon_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentiment.lexicon_score(posts(spark, sf_dir), _rated(spark))


@_query
def lexicon_score_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words are rated by their length, so the list of ratings grows with the data."""
    flat = posts(spark, sf_dir)
    words = flat.select(F.explode(tokens(F.col("content"))).alias("word")).distinct()
    lexicon = words.select("word", (F.length("word") - 6).cast("int").alias("rating"))
    return _rounded(sentiment.lexicon_score(flat, lexicon, unique_ids=True))


def _rounded(scored: DataFrame) -> DataFrame:
    """Engines may differ in the last bit of a quotient."""
    return scored.withColumn("tweet_rating", F.round("tweet_rating", 12))


@_query
def lexicon_score_fractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratings with a fraction, more words than are looked up inside a row."""
    flat = posts(spark, sf_dir)
    words = flat.select(F.explode(tokens(F.col("content"))).alias("word")).distinct()
    lexicon = words.select("word", (F.length("word") / 2).alias("rating"))
    return _rounded(sentiment.lexicon_score(flat, lexicon)).select("tweet_id", "tweet_rating")


@_query
def lexicon_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = sentiment.lexicon_sentiment(posts(spark, sf_dir), _rated(spark))
    return scored.select("tweet_id", "tweet_rating", "sentiment")


@_query
def lexicon_neutral(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = sentiment.lexicon_sentiment(posts(spark, sf_dir), _rated(spark), unscored="neutral")
    return scored.select("tweet_id", "tweet_rating", "sentiment")


@_query
def lexicon_drop_unscored(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = sentiment.lexicon_sentiment(
        posts(spark, sf_dir), _rated(spark), tokenizer="delimiters", unscored="drop"
    )
    return scored.select("tweet_id", "tweet_rating", "sentiment")


@_query
def lexicon_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = tokens(F.col("content"), "delimiters")
    return posts(spark, sf_dir).select("id", F.explode(words).alias("word"))


@_query
def lexicon_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written as one folder per sentiment and read back."""
    folder = fresh_folder(spark)
    scored = sentiment.lexicon_sentiment(posts(spark, sf_dir), _rated(spark))
    scored = scored.select("tweet_id", "tweet_rating", "sentiment")
    sinks.write_split(scored, folder, "sentiment")
    schema = "tweet_id bigint, tweet_rating double, sentiment string"
    return spark.read.schema(schema).csv(folder, header=True)


@_query
def rule_sentiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    mood = sentiment.rule_sentiment(F.col("content"), POSITIVE, NEGATIVE)
    return posts(spark, sf_dir).select("id", mood.alias("sentiment"))


@_query
def rule_sentiment_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    mood = sentiment.rule_sentiment(F.col("content"), ["gre_t", "lic"], ["h%te", "sad"], "like")
    return posts(spark, sf_dir).select("id", mood.alias("sentiment"))


@_query
def rule_sentiment_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    mood = sentiment.rule_sentiment(F.col("content"), ["great", "the"], ["hate", "und"], "word")
    return posts(spark, sf_dir).select("id", mood.alias("sentiment"))


def _word_table(spark: SparkSession, sf_dir: str, listed: list[str], rest: int) -> DataFrame:
    """Rule words as a relation, with words of part names, which grow with the data."""
    names_table = table(spark, sf_dir, "part").where(F.col("p_partkey") % 2 == rest)
    spaced = F.transform(F.split("p_name", " "), lambda word: F.concat(word, F.lit(" ")))
    words = names_table.select(F.explode(spaced).alias("word"))
    return words.unionByName(spark.createDataFrame([(word,) for word in listed], "word string")).distinct()


@_query
def rule_sentiment_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule words as relations."""
    positive, negative = (_word_table(spark, sf_dir, *given) for given in ((POSITIVE, 0), (NEGATIVE, 1)))
    return sentiment.with_rule_sentiment(posts(spark, sf_dir), positive, negative).select("id", "sentiment")


@_query
def brand_sentiment_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands and rule words as relations."""
    positive, negative = (_word_table(spark, sf_dir, *given) for given in ((POSITIVE, 0), (NEGATIVE, 1)))
    listed = spark.createDataFrame([(name,) for name in BRANDS], "restaurant string")
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_name").alias("restaurant"))
    return sentiment.brand_sentiment(posts(spark, sf_dir), listed.unionByName(suppliers), positive, negative)


def _pattern_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patterns and their wildcard forms, some without a literal, more with more data."""
    parts = table(spark, sf_dir, "part").select(F.split("p_name", " ").alias("names"))
    first, last = F.get("names", F.lit(0)), F.element_at("names", -1)
    listed = parts.select(F.concat(first, F.lit(".*"), last).alias("pattern"), F.concat(first, F.lit("%"), last).alias("wild"))
    number = F.col("s_suppkey").cast("string")
    numbered = table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("(version|lic) ?"), number, F.lit("[. ]?")).alias("pattern"),
        F.concat(F.lit("@mail"), number, F.lit("_example")).alias("wild"),
    )
    fixed = spark.createDataFrame(
        [("h.te", "h_te"), ("lic[ae]", "gre%t"), ("great|public", "Lic"), ("[xyz]{3}", "%"), ("idiot\\b", "of the %l")],
        "pattern string, wild string",
    )
    return listed.unionByName(numbered).unionByName(fixed)


@_query
def keyword_regex_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """More patterns than are tried one by one, as a relation."""
    flat = posts(spark, sf_dir).select("id", one_line(F.col("content")).alias("content"))
    patterns = _pattern_table(spark, sf_dir).select("pattern").distinct()
    return keywords.keyword_pairs(flat, patterns, match="regex").select("id", "keyword")


@_query
def keyword_like_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    wild = _pattern_table(spark, sf_dir).select("wild").distinct()
    return keywords.keyword_pairs(posts(spark, sf_dir), wild, match="like").select("id", "keyword")


@_query
def keyword_like_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same by joins alone, as for tables of any size."""
    wild = _pattern_table(spark, sf_dir).select("wild").distinct()
    flat = posts(spark, sf_dir).select("id", "content")
    return pairs_by_words(flat, wild, match="like").select("id", "keyword")


@_query
def brand_sentiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentiment.brand_sentiment(
        posts(spark, sf_dir), BRANDS, POSITIVE, NEGATIVE, zero_fill=False
    )


@_query
def brand_sentiment_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentiment.brand_sentiment(
        posts(spark, sf_dir), [*BRANDS, "no such brand"], POSITIVE, NEGATIVE
    )


# Brands and names


@_query
def brand_trend_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brands.brand_trend(table(spark, sf_dir, "pages"), NAMES, "html")


@_query
def brand_by_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brands.brand_by_location(posts(spark, sf_dir), NAMES)


@_query
def brand_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = brands.brand_by_location(posts(spark, sf_dir), NAMES)
    return brands.report_lines(counts, ["restaurant", "location"])


@_query
def report_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The printed report, read back as lines."""
    folder = fresh_folder(spark)
    trend = brands.brand_trend(posts(spark, sf_dir), NAMES, "content")
    sinks.write_report(trend, folder, ["restaurant"])
    return sources.read_lines(spark, folder)


@_query
def name_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    host = F.regexp_extract("url", r"^[a-z]+://([^/?#]+)", 1)
    users = table(spark, sf_dir, "pages").select(host.alias("username"))
    return names.common_substrings(users)


@_query
def name_substring_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = table(spark, sf_dir, "customer").select(F.col("c_name").alias("username"))
    return names.substring_counts(users, min_len=8)


# Sources and sinks


@_query
def json_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.get_json_object("props", "$.k")
    return table(spark, sf_dir, "events").select(
        "event_id", F.expr("try_cast(get_json_object(props, '$.k') AS INT)").alias("k"),
        value.alias("k_text"),
    )


@_query
def json_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "events").select(F.col("props").alias("value"))
    schema = T.StructType([T.StructField("k", T.LongType())])
    parsed = sources.parse_lines(lines, schema)
    return parsed.groupBy("k").agg(F.count("*").alias("count"))


def _written_tweets(spark: SparkSession, sf_dir: str) -> str:
    folder = fresh_folder(spark)
    sinks.write_json(nested(posts(spark, sf_dir)), folder)
    return folder


@_query
def json_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    tweets = sources.read_tweets(spark, _written_tweets(spark, sf_dir), on_error="fail")
    return sources.flatten_tweets(tweets)


@_query
def json_in_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SQL over a file that is not registered anywhere."""
    folder = _written_tweets(spark, sf_dir)
    return spark.sql(
        f"""
        SELECT id, user.username AS username, place.country AS country
        FROM json.`{folder}`
        WHERE lower(content) LIKE concat('%', lower('Err'), '%')
        """
    )


@_query
def text_in_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SQL over lines of a file that is not registered anywhere."""
    folder = _name_file(spark, sf_dir)
    return spark.sql(
        f"""
        SELECT trim(value) AS keyword, count(*) AS count, max(length(value)) AS longest
        FROM text.`{folder}`
        WHERE value LIKE '%ring%'
        GROUP BY trim(value)
        """
    )


@_query
def sql_term_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registered posts, keywords and ratings in SQL: words of posts that are listed and rated."""
    folder = _written_tweets(spark, sf_dir)
    listed, rated = fresh_folder(spark), fresh_folder(spark)
    words = posts(spark, sf_dir).select(F.explode(F.split(F.lower("content"), " ")).alias("value")).distinct()
    words = words.where(F.col("value").rlike(r"\A[a-z]+\z"))
    words.where("length(value) BETWEEN 2 AND 6").write.text(listed)
    ratings = words.where("length(value) BETWEEN 4 AND 9")
    ratings.select("value", F.length("value") - 6).write.csv(rated, sep="\t", quote="")
    sources.register_views(spark, folder, {"listed_words": listed}, {"rated_words": rated})
    return spark.sql(
        """
        SELECT username, count(*) AS words, sum(rating) AS rating
        FROM (SELECT username, explode(split(lower(content), ' ')) AS value FROM tweets)
        JOIN listed_words USING (value) JOIN rated_words ON value = word
        GROUP BY username
        """
    )


@_query
def sql_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Registered views queried in SQL: pairs of posts and listed keywords by user."""
    folder = _written_tweets(spark, sf_dir)
    sources.register_views(spark, folder)
    return spark.sql(
        """
        SELECT username, count(*) AS count
        FROM (
            SELECT username,
                   explode(filter(array('great', 'public', 'lic', 'und'),
                                  k -> contains(lower(content), k))) AS keyword
            FROM tweets
        )
        GROUP BY username
        ORDER BY count DESC, username
        """
    )


@_query
def json_bad_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record once whole, once cut off and once with a wrong type: only the first stays."""
    folder = fresh_folder(spark)
    whole = table(spark, sf_dir, "events").select(
        F.to_json(
            F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("content"))
        ).alias("value")
    )
    cut = whole.select(F.expr("substring(value, 1, length(value) - 1)").alias("value"))
    typed = table(spark, sf_dir, "events").select(
        F.format_string('{"id":%d,"likeCount":"many"}', "event_id").alias("value")
    )
    whole.unionByName(cut).unionByName(typed).write.text(folder)
    lines = sources.read_lines(spark, folder)
    good = sources.read_tweets(spark, folder).select("id", F.lit("good").alias("kind"))
    bad = sources.bad_lines(lines).select(
        F.regexp_extract("value", r'"id":(\d+)', 1).cast("bigint").alias("id"),
        F.lit("bad").alias("kind"),
    )
    return good.unionByName(bad)


@_query
def json_dropped_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many lines of a file are read and dropped, counted while it is read."""
    folder = fresh_folder(spark)
    lines = table(spark, sf_dir, "events").select(
        F.when(F.col("event_id") % 3 == 0, F.format_string('{"id":%d', "event_id"))
        .when(F.col("event_id") % 5 == 0, F.format_string('{"id":"x%d"}', "event_id"))
        .otherwise(F.format_string('{"id":%d}', "event_id")).alias("value")
    )
    lines.write.text(folder)
    counts = Observation("tweets")
    kept = written(sources.read_tweets(spark, folder, counts=counts))
    seen = counts.get
    return kept.agg(F.count("*").alias("kept")).select(
        "kept", F.lit(seen["lines"]).alias("lines"), F.lit(seen["bad_lines"]).alias("bad_lines")
    )


@_query
def json_same_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many records of a file with bad lines are read, by the columns that are used."""
    folder = fresh_folder(spark)
    lines = table(spark, sf_dir, "events").select(
        F.when(F.col("event_id") % 5 == 0, F.format_string('{"id":%d,"likeCount":"many"}', "event_id"))
        .when(F.col("event_id") % 7 == 0, F.format_string('{"id":%d,', "event_id"))
        .otherwise(F.format_string('{"id":%d,"likeCount":3}', "event_id")).alias("value")
    )
    lines.write.text(folder)
    tweets = sources.read_tweets(spark, folder)
    one = tweets.select("id").agg(F.count("*").alias("rows"))
    other = tweets.select("likeCount").agg(F.count("*").alias("rows"))
    every = tweets.agg(F.count("*").alias("rows"))
    named = [df.select(F.lit(name).alias("used"), "rows") for name, df in (("id", one), ("likeCount", other), ("none", every))]
    return named[0].unionByName(named[1]).unionByName(named[2])


@_query
def csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_folder(spark)
    rows = posts(spark, sf_dir).select(
        "id", one_line(F.col("content")).alias("content"), "likeCount", "fullName"
    )
    sinks.write_csv(rows, folder)
    schema = "id bigint, content string, likeCount bigint, fullName string"
    return spark.read.schema(schema).csv(folder, header=True, escape='"')


@_query
def csv_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with their line ends, blanks at the ends, quotes and missing values."""
    folder = fresh_folder(spark)
    rows = posts(spark, sf_dir).select("id", _framed().alias("content"), "location")
    sinks.write_csv(rows, folder)
    return sources.read_table(spark, folder, rows.schema)


@_query
def delimited_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_folder(spark)
    rows = posts(spark, sf_dir).select("id", _framed().alias("content"), "location")
    sinks.write_delimited(rows, folder)
    return sources.read_table(spark, folder, rows.schema, sep="|", header=False)


def _framed() -> Column:
    """A text with signs around it that a file could lose."""
    return F.concat(F.lit(' \t"a|b",'), F.col("content"), F.lit('\r\n\\"\n '))


@_query
def cast_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields read as text and cast afterwards, NULL where that fails."""
    value = F.get_json_object("props", "$.k")
    fields = table(spark, sf_dir, "events").select(
        "event_id", value.alias("k"), F.concat(value, F.lit(".5")).alias("half"), F.col("event_type").alias("kind")
    )
    return sources.cast_columns(fields, {"k": "bigint", "half": "double", "kind": "int"})


@_query
def delimited_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_folder(spark)
    rows = posts(spark, sf_dir).select("id", one_line(F.col("content")).alias("content"))
    sinks.write_delimited(rows, folder, sep="|")
    return spark.read.schema("id bigint, content string").csv(folder, sep="|", escape='"')


@_query
def ranked_tsv(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_folder(spark)
    sinks.write_ranked(keywords.rank_users(posts(spark, sf_dir), PRO), folder, "username")
    return spark.read.schema("username string, count bigint").csv(folder, sep="\t")


@_query
def count_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_folder(spark)
    matches = keywords.censor(posts(spark, sf_dir), TERMS).matches
    sinks.write_count(matches, folder)
    return spark.read.schema("numero bigint").json(folder)


@_query
def lexicon_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rated list written as tab-separated lines and read back."""
    folder = fresh_folder(spark)
    words = table(spark, sf_dir, "customer").select(
        F.col("c_name").alias("word"), F.col("c_nationkey").cast("int").alias("rating")
    )
    words.write.csv(folder, sep="\t", quote="")
    return sources.read_lexicon(spark, folder)


def _name_file(spark: SparkSession, sf_dir: str) -> str:
    folder = fresh_folder(spark)
    names_table = table(spark, sf_dir, "part").select(
        F.concat(F.lit(" "), "p_name", F.lit("  ")).alias("value")
    )
    names_table.write.text(folder)
    return folder


@_query
def keyword_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.read_keywords(spark, _name_file(spark, sf_dir))


@_query
def name_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sources.read_names(spark, _name_file(spark, sf_dir))


# Topics


# A short stop list, so that the same cleaning can be written in plain SQL.
STOP = ["the", "of", "and", "to", "in", "https", "news"]


@_query
def cleaned_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = clean_tokens(F.col("content"), STOP)
    return posts(spark, sf_dir).select("id", F.explode(words).alias("token"))


@_query
def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = topics.tokenized(posts(spark, sf_dir).select("id", "content"), stop=STOP)
    return topics.vocabulary(docs)


@_query
def bag_of_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = topics.tokenized(posts(spark, sf_dir).select("id", "content"), stop=STOP)
    return topics.bag_of_words(docs)


@_query
def sample_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topics.sample_rows(posts(spark, sf_dir).select("id", "username"), 100)


@_query
def limit_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return posts(spark, sf_dir).select("id", "username").orderBy("id").limit(10)


@_query
def topic_kept_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with a topic, by a model that was saved and loaded: those with a known word."""
    flat = posts(spark, sf_dir).select("id", "content")
    folder = fresh_folder(spark)
    topics.save_topics(topics.fit_topics(flat, k=3, passes=1, stop=STOP), folder)
    return topics.assign_topics(flat, topics.load_topics(folder), stop=STOP).select("id")


@_query
def topic_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts counted under a topic, without and with those that hold no known word."""
    flat = posts(spark, sf_dir).select("id", "content")
    model = topics.fit_topics(flat, k=3, passes=1, stop=STOP)
    kept = topics.topic_counts(flat, model, stop=STOP).agg(F.sum("count").alias("kept"))
    every = topics.topic_counts(flat, model, drop_empty=False, stop=STOP).agg(F.sum("count").alias("every"))
    rows = kept.select("kept", F.lit(None).cast("bigint").alias("every")).unionByName(
        every.select(F.lit(None).cast("bigint").alias("kept"), "every")
    )
    return rows.agg(F.max("kept").alias("kept"), F.max("every").alias("every"))


@_query
def topic_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = posts(spark, sf_dir).select("id", "content")
    return topics.topic_counts(flat, topics.fit_topics(flat, stop=STOP), stop=STOP)


@_query
def topic_assignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With a model that was saved and loaded again."""
    flat = posts(spark, sf_dir).select("id", "content")
    folder = fresh_folder(spark)
    topics.save_topics(topics.fit_topics(flat, k=5, stop=STOP), folder)
    assigned = topics.assign_topics(flat, topics.load_topics(folder), drop_empty=False, stop=STOP)
    return assigned.select("id", "topic_id")


@_query
def topic_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = posts(spark, sf_dir).select("id", "content")
    return topics.topic_labels(flat, topics.fit_topics(flat, k=5, stop=STOP))
