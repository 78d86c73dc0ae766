"""Literals of patterns, and term tables of middle and of any size."""

import re

import pytest
from conftest import plan, rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from postsift.operators import keywords, skew, term_join
from postsift.operators.literals import like_cover, regex_cover, word_part
from postsift.operators.term_index import TermIndex
from postsift.operators.term_join import keys_by_words, pairs_by_words


def test_covers():
    assert like_cover("a%great_b") == ["great"]
    assert like_cover(r"50\% off_x") == ["50% off"]
    assert like_cover("%_") is None
    assert regex_cover("Great|public") == ["great", "public"]
    assert regex_cover("Great|pub(lic|ish)ed") == ["great", "pub"]
    assert regex_cover("colou?r") == ["colo"]
    assert regex_cover("ab{2}c*d") == ["ab"]
    assert regex_cover("x(?:foo|barr)+y") == ["barr", "foo"]
    assert regex_cover("(abc)?") is None
    assert regex_cover("[abc]+.") is None
    assert regex_cover("vac+una\\.") == ["una."]
    assert regex_cover("a|") is None
    assert regex_cover("(?i)abc") is None and regex_cover("\\Qabc") is None and regex_cover("[a[b]]c") is None
    assert word_part("of the people ") == "people"


pieces = st.sampled_from(["a", "b", "ab", "A", ".", "[ab]", "\\w", "é", " "])
patterns = st.recursive(
    pieces,
    lambda inner: st.one_of(
        st.lists(inner, min_size=1, max_size=4).map("".join),
        st.tuples(inner, inner).map(lambda p: f"({p[0]}|{p[1]})"),
        st.tuples(inner, st.sampled_from(["*", "+", "?", "{2}", "{0,1}", "*?"])).map(lambda p: f"(?:{p[0]}){p[1]}"),
    ),
    max_leaves=8,
)


@settings(max_examples=500, deadline=None)
@given(patterns, st.text("abABé ", max_size=12))
def test_every_match_holds_a_literal_of_the_cover(pattern, text):
    cover = regex_cover(pattern)
    if cover is not None and re.search(pattern, text, re.IGNORECASE | re.ASCII):
        assert any(literal in text.lower() for literal in cover)


@settings(max_examples=200, deadline=None)
@given(st.text("ab%_", max_size=6), st.text("ab", max_size=8))
def test_every_like_match_holds_its_literal(pattern, text):
    cover = like_cover(pattern)
    regex = "".join({"%": ".*", "_": "."}.get(c, c) for c in pattern)
    if cover and re.search(regex, text):
        assert cover[0] in text


@pytest.fixture(scope="module")
def texts(spark):
    """Texts of numbered words, one word in nine of ten of them, and a text without a blank."""
    rows = [(i, f"w{i % 97} common w{i % 89}x {'the end' if i % 7 else 'End'}" if i % 10 else f"w{i % 53} other") for i in range(2_000)]
    rows += [(5_000, None), (5_001, ""), (5_002, "   "), (5_003, "z" * 5_000 + "w13x" + "z" * 5_000)]
    return spark.createDataFrame(rows, "id bigint, content string").cache()


def table_of(spark, terms):
    return spark.createDataFrame([(term,) for term in terms], "term string")


def test_a_table_of_middle_size_is_looked_up_without_a_join(spark, texts, tmp_path):
    listed = [f"w{i}x" for i in range(3_000)] + ["common", "the end", "", "  "]
    texts.write.parquet(str(tmp_path / "texts"))
    stored = spark.read.parquet(str(tmp_path / "texts"))
    found = keywords.keyword_pairs(stored, table_of(spark, listed))
    assert "Join" not in plan(found) and "Exchange" not in plan(found)
    want = sorted((r["id"], t) for r in texts.collect() if r["content"] is not None for t in listed if t in r["content"].lower())
    assert sorted((r["id"], r["keyword"]) for r in found.collect()) == want


def test_five_thousand_patterns_are_not_tried_one_by_one(spark, texts):
    listed = [f"w{i}x.*end" for i in range(2_500)] + [f"(w{i}|v{i}) other" for i in range(2_500)]
    table = table_of(spark, listed)
    found = {(r["id"], r["keyword"]) for r in keywords.keyword_pairs(texts, table, match="regex").collect()}
    assert not TermIndex(table, "regex", True).always
    want = set()
    for row in texts.where("content IS NOT NULL").collect():
        number = re.match(r"w(\d+) other", row["content"])
        if number:
            want |= {(row["id"], f"(w{i}|v{i}) other") for i in range(2_500) if number[1] == str(i)}
        suffix = re.search(r"w(\d+)x.*end", row["content"], re.IGNORECASE)
        if suffix:
            numbers = re.findall(r"w(\d+)x", row["content"])
            want |= {(row["id"], f"w{n}x.*end") for n in numbers}
    assert found == want


def test_long_words_are_cut_without_losing_terms(spark, texts):
    table = table_of(spark, ["zw13xz", "w13x"])
    long = texts.where("id = 5003")
    assert rows(pairs_by_words(long, table), "keyword") == [("w13x",), ("zw13xz",)]


def test_existence_does_not_list_pairs(spark, texts):
    table = table_of(spark, ["common", "the end", "w1 other", "nothing"])
    keys = keys_by_words(texts, table)
    assert keys.count() == keys.distinct().count()
    want = {r["content"] for r in texts.collect() if r["content"] and any(t in r["content"].lower() for t in ["common", "the end", "w1 other"])}
    assert keys.count() == len(want)


def test_a_hot_word_is_spread(spark, texts):
    """One word in nine of ten texts: no part of it is larger than what partitions get on average."""
    words = texts.select("id", F.explode(F.split("content", " ")).alias("word")).where("word <> ''")
    hot = skew.hot_keys(words, "word").cache()
    assert {"common"} <= {r["word"] for r in hot.collect()}
    parts = skew.spread(words, hot, "word", F.col("id")).groupBy("word", "__salt").count()
    total, partitions = words.count(), int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert parts.agg(F.max("count")).first()[0] < total / partitions / 2
    right = words.select("word").distinct()
    joined = skew.spread(words, hot, "word", F.col("id")).join(skew.copied(right, hot, "word"), ["word", "__salt"])
    assert joined.count() == total
    sizes = [r["n"] for r in joined.repartition(partitions, "word", "__salt").groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert max(sizes) < 3 * sorted(sizes)[len(sizes) // 2]


def joined_rows(monkeypatch, module):
    """The numbers of rows that the joins of a module make, as they are made."""
    made = []

    def counted(*given):
        joined = skew.spread_join(*given)
        made.append(joined.count())
        return joined

    monkeypatch.setattr(module, "spread_join", counted)
    return made


def test_pieces_with_the_same_start_are_not_all_compared_with_a_word(spark, monkeypatch):
    texts = spark.createDataFrame([(i, f"customs{i} by customer#{i:09d}.") for i in range(300)], "id bigint, content string")
    table = table_of(spark, [f"Customer#{i:09d}" for i in range(0, 3_000, 2)])
    made = joined_rows(monkeypatch, term_join)
    found = pairs_by_words(texts, table).select("id", "keyword").collect()
    assert sorted(found) == [(i, f"Customer#{i:09d}") for i in range(0, 300, 2)]
    assert max(made) <= 600


def test_terms_that_share_a_frequent_word_are_found_by_their_rarest_one(spark, monkeypatch):
    texts = spark.createDataFrame([(i, f"a large ring {i} of enlarged ring {i}0 x") for i in range(200)], "id bigint, content string")
    table = table_of(spark, [f"Large ring {i} " for i in range(2_000)] + ["rge  ring 1 ", "ring 1 of", "ring 1 on"])
    made = joined_rows(monkeypatch, term_join)
    found = {(r["id"], r["keyword"]) for r in pairs_by_words(texts, table).collect()}
    want = {(i, f"Large ring {i} ") for i in range(200)} | {(1, "ring 1 of")}
    assert found == want
    # The 2,000 terms, each by two words; 200 texts and the 220 terms whose words are there.
    assert max(made) <= 4_000
    assert keys_by_words(texts, table).count() == 200


def test_censoring_lists_no_pairs_for_what_is_kept(spark, texts, monkeypatch):
    table = table_of(spark, ["common", "the end"])
    want = rows(keywords.censor(texts, table, "anti").kept)
    monkeypatch.setattr(keywords, "local_terms", lambda *_: None)
    listed = []
    monkeypatch.setattr(keywords, "pairs_by_words", lambda *given: listed.append(given) or pairs_by_words(*given))
    parts = keywords.censor(texts, table, "anti")
    assert rows(parts.kept) == want and not listed
    assert parts.matches.count() and len(listed) == 1


def test_words_that_hold_no_piece_are_not_moved(spark, texts, monkeypatch):
    table = table_of(spark, ["w13x", "the end", "common w1x "])
    want = rows(pairs_by_words(texts, table))
    monkeypatch.setattr(term_join, "fits_in_memory", lambda _: False)
    sent = []
    monkeypatch.setattr(term_join, "_likely", lambda words, touched, likely=term_join._likely: sent.append(likely(words, touched)) or sent[-1])
    assert rows(pairs_by_words(texts, table)) == want
    assert {r["word"] for r in sent[0].select("word").distinct().collect()} >= {"w13x", "the"}
    assert sent[0].where("word = 'common'").isEmpty()
