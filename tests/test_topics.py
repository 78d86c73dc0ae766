import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from postsift.functions import clean_tokens, stop_words, tokens
from postsift.operators import topics


@pytest.fixture(scope="module")
def docs(spark):
    texts = ["apple pear apple plum", "dog cat bird dog", "pear plum fig apple", "bird cat dog"]
    rows = [(i, f"{texts[i % 4]} word{i % 3}") for i in range(40)] + [(40, ""), (41, None)]
    return spark.createDataFrame(rows, "id bigint, content string").cache()


@pytest.fixture(scope="module")
def model(docs):
    return topics.fit_topics(docs, k=3, min_docs=2, max_share=0.9)


def test_tokens(spark):
    df = spark.createDataFrame([('say "yes" (now),  ok*',)], "content string")
    row = df.select(tokens(F.col("content")), tokens(F.col("content"), "delimiters")).first()
    assert list(row) == [["say", '"yes"', "(now),", "ok*"], ["say", "yes", "now", "ok"]]


def test_cleaning(spark):
    text = "The NEWS, don't stop: e-mail https://x.y Été 42nd end."
    df = spark.createDataFrame([(text,), (None,)], "content string")
    cleaned = [row[0] for row in df.select(clean_tokens(F.col("content"))).collect()]
    assert cleaned == [["stop", "été", "42nd", "end"], None]
    assert {"https", "news", "the"} <= set(stop_words())


def test_vocabulary_bounds(docs):
    known = topics.vocabulary(topics.tokenized(docs), min_docs=14, max_share=0.4)
    assert rows(known) == [("word0", 14)]


def test_bags(spark):
    df = spark.createDataFrame([(1, ["b", "a", "b"]), (2, []), (3, None), (4, ["c"])], "id int, tokens array<string>")
    assert rows(topics.bag_of_words(df)) == [(1, "a", 1), (1, "b", 2), (4, "c", 1)]


def test_samples_are_repeatable_and_of_the_asked_size(spark):
    df = spark.range(5000).repartition(7)
    first = rows(topics.sample_rows(df, 100))
    assert len(set(first)) == 100
    assert rows(topics.sample_rows(df.repartition(3), 100)) == first
    assert topics.sample_rows(df, 10_000).count() == 5000


def test_every_text_gets_a_topic_or_is_dropped(docs, model):
    assert topics.assign_topics(docs, model).count() == 40
    filled = topics.assign_topics(docs, model, drop_empty=False)
    assert filled.count() == 42
    assert filled.where("topic_id is null or topic_id < 0 or topic_id > 2").count() == 0
    assert rows(filled) == rows(topics.assign_topics(docs, model, drop_empty=False))


def test_labels_and_counts(docs, model):
    labels = topics.topic_labels(docs, model, words=2)
    assert [row["topic_id"] for row in labels.collect()] == [0, 1, 2]
    assert all(len(row["topic_words"].split()) == 2 for row in labels.collect())
    counts = topics.topic_counts(docs, model)
    assert sum(row["count"] for row in counts.collect()) == 40
    by_label = topics.assign_topics(docs, model).join(topics.topic_labels(docs, model), "topic_id")
    assert rows(by_label.groupBy("topic_words").count()) == rows(counts)


def test_fitting_twice_gives_the_same_model(docs, model):
    again = topics.fit_topics(docs, k=3, min_docs=2, max_share=0.9)
    assert rows(topics.topic_labels(docs, again)) == rows(topics.topic_labels(docs, model))


def test_saved_models_work_alike(docs, model, tmp_path):
    path = str(tmp_path / "model")
    topics.save_topics(model, path)
    topics.save_topics(model, path)
    loaded = topics.load_topics(path)
    assert rows(topics.assign_topics(docs, loaded)) == rows(topics.assign_topics(docs, model))


def test_many_updates(docs):
    model = topics.fit_topics(docs, k=2, chunk=10, passes=1, min_docs=1, max_share=1.0)
    assert topics.topic_labels(docs, model).count() == 2


def plain_fit(texts, words, k, passes, seed, steps):
    """The same model by loops over texts, words and topics."""
    smoothing = 1 / k
    weights = topics.first_weights(k, len(words), seed).tolist()
    bags = [{words.index(w): text.split().count(w) for w in set(text.split()) if w in words} for text in texts]
    for _ in range(passes):
        dealt = [[0.0] * len(words) for _ in range(k)]
        for bag in bags:
            sizes = [1.0] * k
            for step in range(steps):
                after = [smoothing] * k
                for word, n in bag.items():
                    joint = [sizes[t] * weights[t][word] for t in range(k)]
                    for t in range(k):
                        share = n * joint[t] / sum(joint)
                        after[t] += share
                        if step == steps - 1:
                            dealt[t][word] += share
                sizes = after
        weights = [[(n + smoothing) / (sum(row) + len(words) * smoothing) for n in row] for row in dealt]
    return weights, [sum(row) for row in dealt]


def test_training_uses_every_word_of_every_text(spark):
    texts = [f"w{i % 7} w{i % 5} w{i % 5} x{i % 3}" for i in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, content string")
    options = dict(k=3, passes=3, min_docs=1, max_share=1.0, stop=[])
    model = topics.fit_topics(df.repartition(5), **options)
    weights, mass = plain_fit(texts, list(model.words), 3, 3, 11, model.steps)
    assert model.weights == pytest.approx(pytest.importorskip("numpy").array(weights), abs=1e-12)
    assert model.mass == pytest.approx(mass) and sum(mass) == pytest.approx(60 * 4)
    # Neither the layout nor the size of the blocks matters.
    other = topics.fit_topics(df.coalesce(1), chunk=7, **options)
    assert other.weights == pytest.approx(model.weights, abs=1e-12)


def test_copies_of_all_texts_give_the_same_topics(docs, model):
    """What training does with a text does not depend on how many there are."""
    twice = topics.fit_topics(docs.unionByName(docs), k=3, min_docs=4, max_share=0.9)
    assert twice.words == model.words
    assert twice.mass == pytest.approx(2 * model.mass, rel=0.05)


def test_no_text_has_a_known_word(docs, model):
    strange = docs.selectExpr("id", "'zzz' AS content")
    assert topics.assign_topics(strange, model).count() == 0
    filled = topics.assign_topics(strange, model, drop_empty=False)
    assert {row["topic_id"] for row in filled.collect()} == {int(model.mass.argmax())}
    assert topics.assign_topics(docs.limit(0), model, drop_empty=False).collect() == []


def test_weights_as_a_table(spark, model):
    table = topics.topic_weights(spark, model)
    assert [row["term"] for row in table.orderBy("place").collect()] == list(model.words)
    total = table.select(F.explode("weights").alias("w")).agg(F.sum("w")).first()[0]
    assert total == pytest.approx(3)


def test_texts_adjusted_together_are_adjusted_as_one_by_one(monkeypatch):
    made = np.random.default_rng(3)
    lengths = made.integers(1, 60, 80)
    words = np.concatenate([made.choice(200, size, replace=False) for size in lengths])
    starts = np.append(0, np.cumsum(lengths))[:-1]
    counts = made.integers(1, 5, len(words))
    by_word = np.ascontiguousarray(topics.first_weights(7, 200, 11).T)
    monkeypatch.setattr(topics, "BATCH_ENTRIES", 100)
    sizes, dealt = topics._adjusted(topics._Bags(words, counts, starts), by_word, 0.1, 8)
    for text, (start, size) in enumerate(zip(starts, lengths)):
        entry = slice(start, start + size)
        now = np.ones(7)
        for _ in range(8):
            each = now * by_word[words[entry]]
            each *= (counts[entry] / each.sum(axis=1))[:, None]
            now = 0.1 + each.sum(axis=0)
        assert np.allclose(now, sizes[text], rtol=1e-12) and np.allclose(each, dealt[entry], rtol=1e-12)
