import pytest
from conftest import plan, rows
from pyspark.sql import functions as F

from postsift.functions import MATCHES, any_match, matched_terms
from postsift.operators import keywords
from postsift.operators.term_join import pairs_by_words

CATS = ["cat ", "kitten"]
PHRASES = ["Vaccines save lives", "Mercury in shots", "fear"]


def test_one_row_per_post_and_keyword(posts):
    pairs = keywords.keyword_pairs(posts, CATS)
    assert rows(pairs, "id", "keyword") == [(1, "cat "), (1, "kitten"), (2, "cat "), (2, "kitten")]


def test_keywords_with_capitals_need_folding(posts):
    folded = keywords.keyword_pairs(posts, PHRASES)
    raw = keywords.keyword_pairs(posts, PHRASES, fold_keyword=False)
    assert rows(folded, "id", "keyword") == [(3, "Mercury in shots"), (3, "Vaccines save lives")]
    assert rows(raw) == []


def test_a_whole_text_pattern_stops_at_a_line_end(posts):
    assert rows(keywords.keyword_pairs(posts, PHRASES, match="regex")) == []
    lines = posts.withColumn("content", F.translate("content", "\n", " "))
    found = keywords.keyword_pairs(lines, PHRASES, match="regex")
    assert [row[0] for row in rows(found, "id")] == [3, 3]


def test_wildcards_only_count_in_like(posts):
    assert rows(keywords.keyword_pairs(posts, ["k_c"], match="like"), "id") == [(4,), (6,), (8,)]
    assert rows(keywords.keyword_pairs(posts, ["k_c"])) == []


def test_a_pattern_with_alternatives_stays_one_pattern(spark):
    df = spark.createDataFrame([("xb",), ("ay",), ("c",)], "content string")
    found = keywords.keyword_pairs(df, ["a|b"], match="regex")
    # `.*a|b.*` has to match the whole text by one of its two sides.
    assert rows(found, "content") == []


def test_spaced_and_whole_words(posts):
    assert rows(keywords.keyword_pairs(posts, ["cat"], match="spaced"), "id") == [(1,), (2,)]
    assert rows(keywords.keyword_pairs(posts, ["kitten"], match="spaced"), "id") == []
    assert rows(keywords.keyword_pairs(posts, ["kitten"], match="word"), "id") == [(1,), (2,)]
    assert rows(keywords.keyword_pairs(posts, ["hate"], match="word"), "id") == []
    assert rows(keywords.keyword_pairs(posts, ["hate"]), "id") == [(4,), (8,)]


def test_repeated_and_empty_keywords_count_as_listed(posts):
    pairs = keywords.keyword_pairs(posts, ["kitten", "kitten", ""])
    assert pairs.where("keyword = 'kitten'").count() == 4
    assert pairs.where("keyword = ''").count() == 7


@pytest.mark.parametrize("match", MATCHES)
def test_missing_text_and_empty_lists(posts, match):
    missing = posts.where("content is null")
    result = missing.select(
        matched_terms(F.col("content"), ["x"], match).alias("a"),
        matched_terms(F.col("content"), [], match).alias("b"),
        any_match(F.col("content"), ["x"], match).alias("c"),
    ).first()
    assert tuple(result) == (None, None, False)
    assert keywords.keyword_pairs(posts, [], match=match).count() == 0


@pytest.mark.parametrize("match", MATCHES)
def test_any_match_agrees_with_matched_terms(posts, match):
    terms = ["cat", "KFC", "my", "b.d", "sh_ts"]
    differing = posts.where(
        any_match(F.col("content"), terms, match)
        != F.coalesce(F.size(matched_terms(F.col("content"), terms, match)) > 0, F.lit(False))
    )
    assert differing.count() == 0


def test_censor_keeps_each_remaining_row_once_or_all(posts):
    flat = posts.select("content", "username", "likeCount", "retweetCount")
    by_except = keywords.censor(flat, CATS, "except")
    by_anti = keywords.censor(flat, CATS, "anti")
    assert by_except.kept.count() == 5
    assert by_anti.kept.count() == 6
    assert by_except.matches.count() == 4
    assert keywords.censor(flat, CATS, count="tweets").matches.count() == 2
    # The definition: a set difference, and an anti join on the text.
    assert rows(by_except.kept) == rows(flat.subtract(by_except.matches))
    hits = by_anti.matches.select("content").distinct()
    assert rows(by_anti.kept) == rows(
        flat.join(hits, "content", "left_anti").select(*flat.columns)
    )


def test_counts(posts):
    assert keywords.count_matches(posts, CATS).first()[0] == 4
    assert keywords.count_matches(posts, CATS, "tweets").first()[0] == 2
    assert keywords.count_matches(posts.limit(0), CATS).first()[0] == 0


def test_stances(posts):
    totals = keywords.stance_totals(posts, PHRASES[:1], PHRASES[1:])
    assert rows(totals) == [("anti-vacunas", 1), ("pro-vacunas", 1)]
    none = keywords.stance_totals(posts.limit(0), ["a"], ["b"])
    assert rows(none) == [("anti-vacunas", 0), ("pro-vacunas", 0)]
    overlap = keywords.stance_overlap(posts, ["great"], ["kfc", "hate"])
    assert rows(overlap, "id", "pro", "anti", "overlap") == [
        (4, 1, 2, True), (6, 0, 1, False), (8, 1, 2, True)
    ]
    pairs = keywords.stance_pairs(posts, ["great"], ["kfc"])
    assert pairs.groupBy("tipo").count().where("tipo = 'anti-vacunas'").first()[1] == 3


def test_users_are_ranked_with_a_fixed_order_of_ties(posts):
    ranked = keywords.rank_users(posts, ["cat", "kfc", "great"]).collect()
    assert [tuple(row) for row in ranked] == [
        ("alicecat2", 4), ("AliceCat", 2), (None, 1), ("bob", 1)
    ]
    assert keywords.rank_users(posts, ["kfc", "great"], "tweets").first()[1] == 2


TABLE = ["cat ", "kitten", "kitten", "Mercury in shots", "", " ", "kfc is", "bad, b", "t", "zzz", None]


@pytest.mark.parametrize("match", ["contains", "spaced", "word"])
@pytest.mark.parametrize("fold", [True, False])
def test_the_join_finds_what_the_search_finds(spark, posts, match, fold):
    table = spark.createDataFrame([(term,) for term in TABLE], "term string")
    flat = posts.select("id", "content")
    joined = pairs_by_words(flat, table, match=match, fold_keyword=fold)
    listed = [term for term in TABLE if term is not None]
    searched = keywords.keyword_pairs(flat, listed, match=match, fold_keyword=fold)
    assert rows(joined) == rows(searched)


LISTED = ["cat ", "kitten", "KFC", "bad", "my", "my"]
PATTERNS = {"like": ["c_t", "%", "KFC", "_\\%", "my%k"], "regex": ["c.t", "k(it)+ten|bad", "[ab]+", ".*", "(?:my )?cat", "b\\w+,"]}


@pytest.mark.parametrize("way", ["index", "join"])
@pytest.mark.parametrize("match", MATCHES)
def test_lists_too_long_for_a_plan_give_the_same_result(spark, posts, monkeypatch, match, way):
    listed = LISTED + PATTERNS.get(match, [])
    table = spark.createDataFrame([(t,) for t in listed], "term string")
    flat = posts.select("id", "content", "username")
    short = {
        "pairs": rows(keywords.keyword_pairs(flat, table, match=match)),
        "kept": rows(keywords.censor(flat, table, match=match).kept),
        "count": rows(keywords.count_matches(flat, table, "tweets", match=match)),
        "users": rows(keywords.rank_users(flat, table, match=match)),
        "totals": rows(keywords.stance_totals(flat, table, table, match=match)),
        "any": rows(keywords.with_any_match(flat, table, "hit", match=match)),
        "stances": rows(keywords.stance_pairs(flat, table, table, match=match)),
    }
    monkeypatch.setattr("postsift.operators.terms.INLINE_TERMS", 2)
    if way == "join":
        monkeypatch.setattr("postsift.operators.term_index.INDEX_TERMS", 0)
    monkeypatch.setattr("postsift.operators.term_join.slices",
                        lambda terms: __import__("postsift.operators.terms", fromlist=["slices"]).slices(terms, 2))
    long = {
        "pairs": rows(keywords.keyword_pairs(flat, table, match=match)),
        "kept": rows(keywords.censor(flat, table, match=match).kept.select(*flat.columns)),
        "count": rows(keywords.count_matches(flat, table, "tweets", match=match)),
        "users": rows(keywords.rank_users(flat, table, match=match)),
        "totals": rows(keywords.stance_totals(flat, table, table, match=match)),
        "any": rows(keywords.with_any_match(flat, table, "hit", match=match)),
        "stances": rows(keywords.stance_pairs(flat, table, table, match=match)),
    }
    assert long == short


def test_a_short_list_needs_no_join_and_no_shuffle(spark, tmp_path, posts):
    posts.write.parquet(str(tmp_path / "posts"))
    stored = spark.read.parquet(str(tmp_path / "posts"))
    for df in (
        keywords.keyword_pairs(stored, CATS),
        keywords.censor(stored, CATS, "anti").kept,
        keywords.stance_overlap(stored, CATS, ["kfc"]),
    ):
        assert "Join" not in plan(df) and "Exchange" not in plan(df)
    count = plan(keywords.count_matches(stored, CATS))
    assert "ReadSchema: struct<content:string>" in count


@pytest.mark.parametrize("match", ["like", "regex"])
def test_patterns_compiled_per_task_or_per_text_find_the_same(posts, monkeypatch, match):
    terms = ["k_c", "KFC", "c.t", "my", "%ter", "b.d|x", ""]
    constant = rows(keywords.keyword_pairs(posts, terms, match=match), "id", "keyword")
    hits = rows(posts.where(any_match(F.col("content"), terms, match)), "id")
    monkeypatch.setattr("postsift.functions.matching.CONSTANT_PATTERNS", 0)
    assert rows(keywords.keyword_pairs(posts, terms, match=match), "id", "keyword") == constant
    assert rows(posts.where(any_match(F.col("content"), terms, match)), "id") == hits
    assert len(constant) > len(hits) > 0


def test_a_join_that_does_not_fit_in_memory_is_salted(spark, posts, monkeypatch):
    table = spark.createDataFrame([(term,) for term in TABLE], "term string")
    flat = posts.select("id", "content")
    copied = rows(pairs_by_words(flat, table))
    monkeypatch.setattr("postsift.operators.skew.fits_in_memory", lambda df: False)
    assert rows(pairs_by_words(flat, table)) == copied


def test_terms_with_signs_of_other_languages(spark):
    texts = ['say "no"', "it's 100%", "tab\there", "back\\slash", "ÉCOLE", "line\nend", "a b"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, content string")
    for index, text in enumerate(texts):
        assert rows(keywords.keyword_pairs(df, [text]), "id", "keyword") == [(index, text)]
    assert rows(keywords.keyword_pairs(df, ["école"], match="word"), "id") == [(4,)]
    assert rows(keywords.keyword_pairs(df, ["!!", "a  b!"], match="word"), "id") == [(6,)]
