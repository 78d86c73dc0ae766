import pytest
from conftest import plan, rows
from pyspark.sql import functions as F

from postsift.operators import sentiment, skew


@pytest.fixture
def lexicon(spark):
    return spark.createDataFrame([("love", 3), ("great", 3), ("bad", -3)], "word string, rating int")


EXPECTED = [
    (1, 3.0, "positive"), (2, 3.0, "positive"), (3, None, "negative"), (4, 3.0, "positive"),
    (6, -3.0, "negative"), (7, None, "negative"), (8, 3.0, "positive"),
]


def test_scores_and_labels(posts, lexicon):
    scored = sentiment.lexicon_sentiment(posts, lexicon)
    assert rows(scored, "tweet_id", "tweet_rating", "sentiment") == EXPECTED


def test_unrated_posts(posts, lexicon):
    dropped = sentiment.lexicon_sentiment(posts, lexicon, unscored="drop")
    assert [row[0] for row in rows(dropped, "tweet_id")] == [1, 2, 4, 6, 8]
    neutral = sentiment.lexicon_sentiment(posts, lexicon, unscored="neutral")
    assert rows(neutral.where("sentiment = 'neutral'"), "tweet_id") == [(3,), (7,)]


def test_delimiters_leave_an_empty_text_without_tokens(posts, lexicon):
    scored = sentiment.lexicon_score(posts, lexicon, tokenizer="delimiters")
    assert [row[0] for row in rows(scored, "tweet_id")] == [1, 2, 3, 4, 6, 8]
    # Two ratings now, as the comma no longer sticks to the first word.
    assert scored.where("tweet_id = 6").first()["tweet_rating"] == -3.0


@pytest.mark.parametrize("tokenizer", ["whitespace", "delimiters"])
def test_the_join_scores_like_the_lookup(posts, lexicon, monkeypatch, tokenizer):
    inline = rows(sentiment.lexicon_score(posts, lexicon, tokenizer=tokenizer))
    monkeypatch.setattr(sentiment, "INLINE_WORDS", 1)
    assert rows(sentiment.lexicon_score(posts, lexicon, tokenizer=tokenizer)) == inline
    monkeypatch.setattr(sentiment, "LOOKUP_BYTES", 0)
    assert rows(sentiment.lexicon_score(posts, lexicon, tokenizer=tokenizer)) == inline


def test_fractions_and_repeated_words_are_looked_up_and_joined_alike(spark, posts, monkeypatch):
    listed = [("love", 1.5), ("love", 0.25), ("my", -2.0), ("and", None), (None, 1.0), ("bad", -1.0)]
    lexicon = spark.createDataFrame(listed, "word string, rating double")
    scored = sentiment.lexicon_score(posts, lexicon, unique_ids=True)
    assert "Exchange" not in plan(scored.where("tweet_id > 0"))
    found = rows(scored)
    assert scored.where("tweet_id = 1").first()["tweet_rating"] == (1.75 - 4) / 4
    monkeypatch.setattr(sentiment, "LOOKUP_BYTES", 0)
    assert rows(sentiment.lexicon_score(posts, lexicon, unique_ids=True)) == found


@pytest.mark.parametrize("way", ["inline", "index", "join"])
def test_rule_words_as_relations(spark, posts, monkeypatch, way):
    positive, negative = ["love", "great", "save lives"], ["hate", "bad", "shots!"]
    listed = posts.select("id", sentiment.rule_sentiment(F.col("content"), positive, negative).alias("m"))
    if way != "inline":
        monkeypatch.setattr("postsift.operators.terms.INLINE_TERMS", 1)
    if way == "join":
        monkeypatch.setattr("postsift.operators.term_index.INDEX_TERMS", 0)
    tables = [spark.createDataFrame([(word,) for word in words], "word string") for words in (positive, negative)]
    judged = sentiment.with_rule_sentiment(posts, *tables, name="m")
    assert judged.columns == [*posts.columns, "m"]
    assert rows(judged, "id", "m") == rows(listed)
    brands = spark.createDataFrame([("kfc",), ("starbucks",), ("nowhere",)], "brand string")
    want = rows(sentiment.brand_sentiment(posts, ["kfc", "starbucks", "nowhere"], positive, negative))
    assert rows(sentiment.brand_sentiment(posts, brands, *tables)) == want


def test_the_definition_with_joined_rows(spark, posts, lexicon):
    words = posts.select("id", "content", F.explode(F.split("content", r"\s+")).alias("word"))
    joined = words.join(lexicon, "word", "left")
    expected = joined.groupBy("id", "content").agg(F.avg("rating"))
    assert rows(sentiment.lexicon_score(posts, lexicon)) == rows(expected)


def test_equal_rows_with_one_id_give_one_row(posts, lexicon):
    twice = posts.unionByName(posts)
    assert sentiment.lexicon_score(twice, lexicon).count() == 7
    assert sentiment.lexicon_score(twice, lexicon, unique_ids=True).count() == 14


def test_words_rated_twice_count_twice(spark, posts):
    lexicon = spark.createDataFrame([("love", 3), ("love", 1)], "word string, rating int")
    assert sentiment.lexicon_score(posts.where("id = 1"), lexicon).first()["tweet_rating"] == 2.0
    with pytest.raises(ValueError, match="love"):
        sentiment.unique_words(lexicon)


def test_an_empty_lexicon_rates_nothing(posts, lexicon):
    scored = sentiment.lexicon_score(posts, lexicon.limit(0))
    assert scored.where("tweet_rating is not null").count() == 0
    assert scored.count() == 7


def test_scoring_unique_ids_shuffles_nothing(spark, tmp_path, posts, lexicon):
    posts.write.parquet(str(tmp_path / "posts"))
    stored = spark.read.parquet(str(tmp_path / "posts"))
    assert "Exchange" not in plan(sentiment.lexicon_score(stored, lexicon, unique_ids=True))


def test_rules(posts):
    mood = posts.select("id", sentiment.rule_sentiment(F.col("content")).alias("m"))
    assert rows(mood) == [
        (1, "positive"), (2, "positive"), (3, "neutral"), (4, "positive"), (5, "neutral"),
        (6, "negative"), (7, "neutral"), (8, "positive"),
    ]
    inside = posts.where("id = 4").select(sentiment.rule_sentiment(F.col("content"), [], ["hate"]))
    assert inside.first()[0] == "negative"
    whole = posts.where("id = 4").select(
        sentiment.rule_sentiment(F.col("content"), [], ["hate"], match="word")
    )
    assert whole.first()[0] == "neutral"


def test_brand_sentiment(spark, posts):
    found = [("kfc", "negative", 1), ("kfc", "positive", 2), ("starbucks", "negative", 1)]
    assert rows(sentiment.brand_sentiment(posts, zero_fill=False)) == found
    filled = sentiment.brand_sentiment(posts).collect()
    assert len(filled) == 9
    assert sorted(tuple(row) for row in filled if row["count"]) == found
    assert [tuple(row)[:2] for row in filled] == sorted(tuple(row)[:2] for row in filled)
    table = spark.createDataFrame([("kfc",), ("mcdonald's",), ("starbucks",)], "brand string")
    assert rows(sentiment.brand_sentiment(posts, table)) == sorted(tuple(row) for row in filled)


def test_words_with_quotes_and_backslashes(spark):
    df = spark.createDataFrame([(1, "can't a\\b ok")], "id bigint, content string")
    quoted = spark.createDataFrame([("can't", -3), ("ok", 1)], "word string, rating int")
    assert sentiment.lexicon_score(df, quoted).first()["tweet_rating"] == -1.0
    slashed = spark.createDataFrame([("a\\b", 2)], "word string, rating int")
    assert sentiment.lexicon_score(df, slashed).first()["tweet_rating"] == 2.0


def test_frequent_words_are_looked_up_and_only_rare_ones_joined(spark, monkeypatch):
    texts = spark.createDataFrame(
        [(i, f"the love love of{i} x{i}") for i in range(300)] + [(900, "none here"), (901, ""), (902, None), (1, "the love love of1 x1")],
        "id bigint, content string",
    )
    lexicon = spark.createDataFrame([("love", 3), *((f"x{i}", i) for i in range(300))], "word string, rating int")
    monkeypatch.setattr(sentiment, "INLINE_WORDS", 1)
    want = rows(sentiment.lexicon_score(texts, lexicon))
    monkeypatch.setattr(sentiment, "LOOKUP_BYTES", 100)
    made = []

    def counted(left, *given):
        made.append({r["word"] for r in left.select("word").collect()})
        return skew.spread_join(left, *given)

    monkeypatch.setattr(sentiment, "spread_join", counted)
    assert rows(sentiment.lexicon_score(texts, lexicon)) == want and len(want) == 302
    assert "x7" in made[0] and not {"love", "the"} & made[0]
