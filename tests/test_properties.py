from collections import Counter

from conftest import rows
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from postsift.functions import state_of
from postsift.operators import keywords
from postsift.operators.term_join import pairs_by_words

few = settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
texts = st.lists(st.one_of(st.none(), st.text("abC \n.", max_size=12)), min_size=1, max_size=8)
terms = st.lists(st.text("abC .", max_size=4), max_size=5)


@few
@given(texts=texts, terms=terms)
def test_matches_and_rest_are_the_whole(spark, texts, terms):
    df = spark.createDataFrame([(text,) for text in texts], "content string")
    parts = keywords.censor(df, terms, "anti", count="tweets")
    both = Counter(parts.matches.collect()) + Counter(parts.kept.collect())
    assert both == Counter(df.collect())


@few
@given(texts=texts, terms=terms, fold=st.booleans())
def test_pairs_against_brute_force(spark, texts, terms, fold):
    expected = sorted(
        (index, term)
        for index, text in enumerate(texts)
        for term in terms
        if text is not None and (term.lower() if fold else term) in text.lower()
    )
    df = spark.createDataFrame(list(enumerate(texts)), "id int, content string")
    table = spark.createDataFrame([(term,) for term in terms], "term string")
    inline = keywords.keyword_pairs(df, terms, fold_keyword=fold)
    joined = pairs_by_words(df, table, fold_keyword=fold)
    assert rows(inline, "id", "keyword") == expected
    assert rows(joined, "id", "keyword") == expected


@few
@given(texts=texts, terms=terms)
def test_difference_is_the_set_difference(spark, texts, terms):
    df = spark.createDataFrame([(text, 1) for text in texts], "content string, n int")
    parts = keywords.censor(df, terms, "except")
    assert rows(parts.kept) == rows(df.subtract(parts.matches))


@few
@given(names=st.lists(st.text("aB, ", max_size=8), min_size=1, max_size=8))
def test_states_against_brute_force(spark, names):
    df = spark.createDataFrame(list(enumerate(names)), "id int, place string")
    found = dict(rows(df.select("id", state_of(F.col("place")))))
    for index, name in enumerate(names):
        parts = name.split(", ")
        assert found[index] == (parts[1] if len(parts) > 1 else None)
