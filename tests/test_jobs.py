from conftest import rows

from postsift.plans import jobs


def test_censor(spark, tweet_file, text_file, tmp_path):
    out = str(tmp_path / "out")
    jobs.censor_job(spark, tweet_file, text_file("kitten", "cat "), out)
    assert spark.read.json(f"{out}/matches").count() == 4
    assert rows(spark.read.json(f"{out}/count")) == [(4,)]
    assert spark.read.json(f"{out}/kept").count() == 5


def test_states(spark, tweet_file, text_file, tmp_path):
    out = str(tmp_path / "out")
    jobs.state_job(spark, tweet_file, text_file("cat", "kfc"), out, count="pairs")
    states = spark.read.json(out)
    assert rows(states, "state", "cantidad_tweets") == [(None, 2), ("B", 1), ("TX", 2), ("USA", 1)]
    assert set(states.schema["tweets"].dataType.elementType.names) == {
        "content", "likeCount", "retweetCount", "username"
    }


def test_stances(spark, tweet_file, text_file, tmp_path):
    out = str(tmp_path / "out")
    pro, anti = text_file("Great", name="pro.txt"), text_file("kfc", "bad", name="anti.txt")
    jobs.stance_job(spark, tweet_file, pro, anti, out)
    assert rows(spark.read.json(f"{out}/totals"), "tipo", "numero") == [
        ("anti-vacunas", 4), ("pro-vacunas", 2)
    ]
    assert rows(spark.read.json(f"{out}/users_pro"), "username", "count") == [("alicecat2", 2)]
    assert spark.read.json(f"{out}/matches/tipo=anti-vacunas").count() == 4


def test_a_side_without_matches_counts_zero(spark, tweet_file, text_file, tmp_path):
    out = str(tmp_path / "out")
    pro, anti = text_file("zzz", name="pro.txt"), text_file("kfc", name="anti.txt")
    jobs.stance_job(spark, tweet_file, pro, anti, out)
    assert rows(spark.read.json(f"{out}/totals"), "tipo", "numero") == [
        ("anti-vacunas", 3), ("pro-vacunas", 0)
    ]


def test_reports(spark, tweet_file, text_file, tmp_path):
    names = text_file("starbucks", "kfc ")
    jobs.trend_job(spark, tweet_file, names, str(tmp_path / "trend"))
    lines = [row[0] for row in spark.read.text(str(tmp_path / "trend")).collect()]
    assert lines == ["kfc            \t3", "starbucks      \t1"]
    jobs.location_job(spark, tweet_file, names, str(tmp_path / "place"))
    assert spark.read.text(str(tmp_path / "place")).count() == 3


def test_substrings(spark, tweet_file, tmp_path):
    jobs.substring_job(spark, tweet_file, str(tmp_path / "out"), top=3)
    lines = [row[0] for row in spark.read.text(str(tmp_path / "out")).collect()]
    assert sorted(lines) == ["alice\t2", "alicec\t2", "aliceca\t2"]


def test_lexicon(spark, tweet_file, text_file, tmp_path):
    out, lexicon = str(tmp_path / "out"), text_file("love\t3", "bad\t-3", "great\t3")
    jobs.lexicon_job(spark, tweet_file, lexicon, out)
    read = spark.read.csv(f"{out}/sentiment=positive", header=True, escape='"', multiLine=True)
    assert sorted(row["tweet_id"] for row in read.collect()) == ["1", "2", "4", "8"]
    jobs.lexicon_job(spark, tweet_file, lexicon, str(tmp_path / "few"), limit=2)
    assert spark.read.csv(str(tmp_path / "few"), header=True).count() == 2


def test_brand_sentiment(spark, tweet_file, tmp_path):
    jobs.brand_sentiment_job(spark, tweet_file, str(tmp_path / "out"))
    assert spark.read.csv(str(tmp_path / "out"), header=True).count() == 9


def test_topics(spark, tweet_file, tmp_path):
    jobs.topic_job(
        spark, tweet_file, str(tmp_path / "out"), str(tmp_path / "model"), k=2, min_docs=1, max_share=1.0
    )
    counts = spark.read.schema("topic string, n bigint").csv(str(tmp_path / "out"), sep="\t")
    assert counts.groupBy().sum("n").first()[0] == 6
