import json
import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .appName("tests")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


def _tweet(id, content, likes, retweets, user, place):
    return {
        "id": id,
        "content": content,
        "likeCount": likes,
        "retweetCount": retweets,
        "user": user,
        "place": place,
    }


US = "United States"
TWEETS = [
    _tweet(1, "I love my cat and my kitten", 3, 1, {"username": "AliceCat", "location": "Austin"},
           {"country": US, "fullName": "Austin, TX"}),
    _tweet(2, "I love my cat and my kitten", 3, 1, {"username": "AliceCat", "location": "Austin"},
           {"country": US, "fullName": "Austin, TX"}),
    _tweet(3, "A bobcat. Mercury in shots!\nVaccines save lives", 0, 0, {"username": "bob"},
           {"country": US, "fullName": "California, USA"}),
    _tweet(4, "Whatever, KFC is great", 9, 2, {"username": "alicecat2", "location": ""},
           {"country": US, "fullName": "Texas"}),
    _tweet(5, None, 1, 0, {"username": "x"}, None),
    _tweet(6, "Starbucks and kfc: bad, bad service", 0, 0, None,
           {"country": US, "fullName": "A, B, C"}),
    _tweet(7, "", 0, 0, {"username": "ALICECAT"}, {"country": "Canada", "fullName": "Toronto, Ontario"}),
    _tweet(8, "Whatever, KFC is great", 9, 2, {"username": "alicecat2", "location": ""},
           {"country": US, "fullName": "Texas"}),
]


@pytest.fixture(scope="session")
def tweet_file(tmp_path_factory):
    path = tmp_path_factory.mktemp("input") / "tweets.json"
    lines = [json.dumps(tweet, ensure_ascii=False) for tweet in TWEETS]
    path.write_text("\n".join([*lines[:4], "{not json", *lines[4:]]) + "\n")
    return str(path)


@pytest.fixture(scope="session")
def posts(spark, tweet_file):
    from postsift.sources import flatten_tweets, read_tweets

    return flatten_tweets(read_tweets(spark, tweet_file)).cache()


@pytest.fixture
def text_file(tmp_path):
    def write(*lines, name="list.txt"):
        path = tmp_path / name
        path.write_text("\n".join(lines) + "\n")
        return str(path)

    return write


def rows(df, *columns):
    """Rows as sorted tuples; None sorts first."""
    chosen = df.select(*columns) if columns else df
    return sorted(map(tuple, chosen.collect()), key=lambda row: [(v is not None, v) for v in row])


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()
