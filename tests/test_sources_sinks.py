import pytest
from conftest import rows
from pyspark.sql import Observation

from postsift import sinks, sources
from postsift.operators import keywords


def test_malformed_lines_are_dropped_or_fail(spark, tweet_file):
    assert len(sources.read_tweets(spark, tweet_file).collect()) == 8
    with pytest.raises(Exception, match="[Mm]alformed"):
        sources.read_tweets(spark, tweet_file, on_error="fail").collect()
    with pytest.raises(ValueError):
        sources.read_tweets(spark, tweet_file, on_error="guess")


def test_bad_lines_can_be_listed(spark, tweet_file):
    lines = sources.read_lines(spark, tweet_file)
    assert rows(sources.bad_lines(lines)) == [("{not json",)]
    parsed = sources.parse_lines(lines)
    assert parsed.count() == 9
    assert parsed.where("id is not null").count() == 8


def test_keyword_lists_keep_or_lose_their_blanks(spark, text_file):
    path = text_file("cat ", "", "kitten", " cat")
    assert rows(sources.read_keywords(spark, path)) == [("",), (" cat",), ("cat ",), ("kitten",)]
    assert rows(sources.read_names(spark, path)) == [("",), ("cat",), ("kitten",)]


def test_lexicons(spark, text_file):
    path = text_file("good\t3", 'so "called"\t-1', "can't stand\t-3")
    assert rows(sources.read_lexicon(spark, path)) == [
        ("can't stand", -3), ("good", 3), ('so "called"', -1)
    ]
    twice = text_file("good\t3", "good\t2", name="twice.txt")
    with pytest.raises(ValueError, match="good"):
        sources.read_lexicon(spark, twice)
    assert sources.read_lexicon(spark, twice, duplicates="keep").count() == 2


def test_views_for_sql(spark, tweet_file, text_file):
    words, rated = text_file("kitten"), text_file("love\t3", name="rated.txt")
    sources.register_views(spark, tweet_file, {"cat_words": words}, {"rated": rated})
    found = spark.sql(
        """SELECT t.id FROM tweets t JOIN cat_words c
           ON lower(t.content) LIKE concat('%', lower(c.value), '%')"""
    )
    assert rows(found) == [(1,), (2,)]
    assert rows(spark.table("rated")) == [("love", 3)]


def test_writers(spark, posts, tmp_path):
    flat = posts.select("id", "content", "username")
    out = str(tmp_path)
    sinks.write_json(flat, f"{out}/json")
    assert rows(spark.read.schema(flat.schema).json(f"{out}/json")) == rows(flat)
    with pytest.raises(Exception, match="[Ee]xists"):
        sinks.write_json(flat, f"{out}/json")

    sinks.write_csv(flat, f"{out}/csv")
    sinks.write_csv(flat, f"{out}/csv")
    read = spark.read.schema(flat.schema).csv(f"{out}/csv", header=True, escape='"', multiLine=True)
    assert rows(read, "id", "username") == rows(flat, "id", "username")

    sinks.write_count(flat, f"{out}/count")
    assert rows(spark.read.json(f"{out}/count")) == [(8,)]

    tricky = spark.createDataFrame([(1, 'a|b "c"'), (2, "plain")], "id bigint, content string")
    sinks.write_delimited(tricky, f"{out}/bar")
    assert rows(spark.read.schema(tricky.schema).csv(f"{out}/bar", sep="|", escape='"')) == rows(tricky)


def test_ranked_lines_are_in_order_over_all_files(spark, posts, tmp_path):
    out = str(tmp_path / "ranked")
    sinks.write_ranked(keywords.rank_users(posts, ["cat", "kfc"]), out, "username")
    lines = []
    for part in sorted((tmp_path / "ranked").glob("part-*")):
        lines += part.read_text().splitlines()
    counts = [int(line.split("\t")[1]) for line in lines]
    assert counts == sorted(counts, reverse=True) and len(counts) == 4


def test_split_by_value(spark, tmp_path):
    df = spark.createDataFrame([(1, "positive"), (2, "negative"), (3, "positive")], "id bigint, sentiment string")
    sinks.write_split(df, str(tmp_path / "csv"), "sentiment")
    sinks.write_split(df, str(tmp_path / "json"), "sentiment", "json")
    one = spark.read.csv(str(tmp_path / "csv" / "sentiment=positive"), header=True)
    assert sorted(row[0] for row in one.collect()) == ["1", "3"]
    assert spark.read.json(str(tmp_path / "json")).count() == 3
    with pytest.raises(ValueError):
        sinks.write_split(df, str(tmp_path / "xml"), "sentiment", "xml")


def test_fields_come_back_whole(spark, tmp_path):
    texts = ["a\nb", "a\r\nb", " lead", "trail ", "\t", 'say "x"', '"', "back\\slash", 'both\\"', "a,b|c", "", None, "é x", "#no comment"]
    df = spark.createDataFrame([(i, text, None if i % 2 else "x") for i, text in enumerate(texts)], "id bigint, content string, last string")
    for parts in (1, 3):
        out = str(tmp_path / str(parts))
        sinks.write_csv(df.repartition(parts), f"{out}/csv")
        assert rows(sources.read_table(spark, f"{out}/csv", df.schema)) == rows(df)
        sinks.write_delimited(df.repartition(parts), f"{out}/bar")
        assert rows(sources.read_table(spark, f"{out}/bar", df.schema, sep="|", header=False)) == rows(df)


def test_dropped_lines_are_counted_while_reading(spark, tweet_file):
    counts = Observation("read")
    kept = sources.read_tweets(spark, tweet_file, counts=counts).select("id").collect()
    assert counts.get == {"lines": 9, "bad_lines": 1} and len(kept) == 8


def test_casts_give_null_where_they_fail(spark):
    df = spark.createDataFrame([("1", "2.5", "x"), ("one", None, "y")], "a string, b string, c string")
    cast = sources.cast_columns(df, {"a": "bigint", "b": "double"})
    assert cast.dtypes == [("a", "bigint"), ("b", "double"), ("c", "string")]
    assert rows(cast) == [(None, None, "y"), (1, 2.5, "x")]
    with pytest.raises(ValueError, match="d, e"):
        sources.cast_columns(df, {"e": "int", "d": "int"})
