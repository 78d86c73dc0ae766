import pytest
from conftest import plan, rows
from pyspark.sql import functions as F

from postsift.functions import state_of
from postsift.operators import places

WORDS = ["cat", "kfc", "great"]


def test_states_by_both_rules(posts):
    states = posts.select(
        "id",
        state_of(F.col("fullName")).alias("second"),
        state_of(F.col("fullName"), "after_comma").alias("after"),
    )
    assert rows(states) == [
        (1, "TX", "TX"), (2, "TX", "TX"), (3, "USA", "USA"), (4, None, None),
        (5, None, None), (6, "B", "B, C"), (7, "Ontario", "Ontario"), (8, None, None),
    ]


def test_counts_of_posts_and_of_pairs(posts):
    # Posts 1 and 2 are equal rows, as are 4 and 8.
    assert rows(places.state_counts(posts, WORDS)) == [(None, 1), ("B", 1), ("TX", 1), ("USA", 1)]
    pairs = places.state_counts(posts, WORDS, count="pairs")
    assert rows(pairs) == [(None, 4), ("B", 1), ("TX", 2), ("USA", 1)]
    assert [row[0] for row in pairs.collect()][:2] == [None, "TX"]


def test_counts_agree_with_gathered_groups(posts):
    found = places.state_matches(posts, WORDS)
    gathered = found.groupBy("state").agg(
        F.size(F.collect_set(F.struct("content", "username", "likeCount", "retweetCount"))).cast("bigint")
    )
    assert rows(gathered) == rows(places.state_counts(posts, WORDS))


@pytest.mark.parametrize("count", places.COUNTS)
@pytest.mark.parametrize("group_size", [1, 2, 1000])
def test_groups_hold_every_member(posts, count, group_size):
    flat = places.state_members(posts, WORDS, count=count)
    groups = places.state_groups(posts, WORDS, count=count, group_size=group_size)
    unnested = groups.select("state", "cantidad_tweets", F.inline("tweets"))
    assert rows(unnested) == rows(flat)
    assert flat.count() == sum(row[1] for row in places.state_counts(posts, WORDS, count=count).collect())
    if group_size == 1000:
        assert groups.where("size(tweets) <> cantidad_tweets").count() == 0


def test_other_countries(posts):
    assert rows(places.state_counts(posts, [""], country="Canada")) == [("Ontario", 1)]
    assert places.state_members(posts, ["cat"], country=None, extra=("id",)).count() == 3


def test_group_counts_need_no_window(posts):
    counted = places.with_group_count(posts.select("id", "username"), "username", "n")
    assert rows(counted, "id", "n") == [
        (1, 2), (2, 2), (3, 1), (4, 2), (5, 1), (6, 1), (7, 1), (8, 2)
    ]
    assert "Window" not in plan(counted)


def test_many_states_are_joined_in_parts(posts, monkeypatch):
    columns = ("state", "cantidad_tweets", "content")
    copied = rows(places.state_members(posts, WORDS), *columns)
    monkeypatch.setattr(places, "FEW_GROUPS", 0)
    assert rows(places.state_members(posts, WORDS), *columns) == copied
