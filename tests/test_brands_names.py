import random
from collections import Counter

from conftest import rows
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from postsift.operators import brands, names
from postsift.sources import read_lines

LISTED = ["kfc ", "starbucks", " kfc"]


def test_brands_are_found_in_any_field_of_a_raw_line(spark, tweet_file):
    trend = brands.brand_trend(read_lines(spark, tweet_file), ["kfc", "starbucks", "alicecat"])
    assert [tuple(row) for row in trend.collect()] == [("alicecat", 5), ("kfc", 3), ("starbucks", 1)]


def test_brands_by_location(posts):
    counts = brands.brand_by_location(posts, LISTED)
    assert [tuple(row) for row in counts.collect()] == [
        ("kfc", "", 2), ("kfc", "desconocida", 1), ("starbucks", "desconocida", 1)
    ]


def test_report_pads_short_names_and_keeps_long_ones(spark):
    df = spark.createDataFrame(
        [("kfc", 2), ("a very long restaurant", 10)], "restaurant string, count bigint"
    )
    lines = [row[0] for row in brands.report_lines(df, ["restaurant"]).collect()]
    assert lines == ["kfc            \t2", "a very long restaurant\t10"]


def test_top_substrings(posts):
    top = names.common_substrings(posts, top=3).collect()
    assert [tuple(row) for row in top] == [("alice", 2), ("alicec", 2), ("aliceca", 2)]


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(
    users=st.lists(st.one_of(st.none(), st.text("abAé ", max_size=9)), max_size=6),
    least=st.integers(1, 6),
)
def test_substrings_against_brute_force(spark, users, least):
    expected = Counter()
    for name in {user.lower() for user in users if user}:
        for start in range(len(name)):
            for end in range(start + least, len(name) + 1):
                expected[name[start:end]] += 1
    df = spark.createDataFrame([(user,) for user in users], "username string")
    assert dict(rows(names.substring_counts(df, min_len=least))) == dict(expected)


def test_common_substrings_of_long_names(spark):
    """Against all substrings, with a name of 20,000 characters, one sign over and over, and ties."""
    rng = random.Random(2)
    users = ["".join(rng.choice("abc") for _ in range(rng.randrange(12))) for _ in range(150)]
    users += ["".join(rng.choice("abcdefgh") for _ in range(20_000)), "z" * 3_000, "Zzzzzzz", "", None, users[0]]
    df = spark.createDataFrame([(user,) for user in users], "username string")
    counts = Counter()
    for name in {user.lower() for user in users if user}:
        for start in range(len(name) - 4):
            counts.update(name[start:end] for end in range(start + 5, min(start + 45, len(name)) + 1))
    for top in (1, 7, 40):
        want = sorted(counts.items(), key=lambda item: (-item[1], item[0]))[:top]
        assert [tuple(row) for row in names.common_substrings(df, top=top).collect()] == want
    few = df.where("username = 'Zzzzzzz'")
    assert [tuple(r) for r in names.common_substrings(few, top=4).collect()] == [
        ("zzzzz", 3), ("zzzzzz", 2), ("zzzzzzz", 1)
    ]
    assert names.common_substrings(df.limit(0)).collect() == []
