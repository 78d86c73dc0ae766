"""Classifiers and rules: exact searches, held-out accuracy, counts by brute force."""

import math
import random
import re
import zlib

import numpy as np
import pytest

from postsift.llm import op01_toxicity as toxicity
from postsift.llm import op05_quality_classifier as quality
from postsift.llm import op10_quality_rules as rules

SF = "/root/testdata/sf0.01"


# Toxicity


def test_index_is_exact():
    rng = np.random.default_rng(1)
    vectors = []
    for _ in range(700):
        terms = np.sort(rng.choice(40, rng.integers(1, 6), replace=False))
        weights = rng.random(len(terms)) + 0.1
        vectors.append((terms, weights / np.sqrt((weights**2).sum())))
    index = toxicity.Index.build(vectors, list(range(700)), [0] * 700, 40)
    dense = np.zeros((700, 40))
    for place, doc in enumerate(index.ids):
        dense[place, vectors[doc][0]] = vectors[doc][1]
    for _ in range(50):
        terms = np.sort(rng.choice(40, rng.integers(1, 5), replace=False))
        weights = rng.random(len(terms))
        weights /= np.sqrt((weights**2).sum())
        places, cosines = index.nearest(terms, weights, 15)
        query = np.zeros(40)
        query[terms] = weights
        every = np.round(dense @ query, 12)
        best = [p for p in np.lexsort((np.arange(700), -every)) if every[p] > 0][:15]
        assert places.tolist() == best
        assert np.allclose(cosines, every[best])


def toxic_rows(n):
    random.seed(5)
    rows = []
    for i in range(n):
        words = [random.choice("alpha beta gamma delta epsilon zeta".split()) for _ in range(30)]
        bad = i % 4 == 0
        if bad:
            words[3] = random.choice(["Vile!", "NASTY,", "foulish", "foulest"])
        rows.append((i, " ".join(words), int(bad)))
    return rows


def test_toxicity_on_held_out_rows(spark):
    rows = toxic_rows(400)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    known = spark.createDataFrame([(r[0], r[2]) for r in rows if r[0] % 5], "doc_id bigint, label int")
    model = toxicity.fit_toxicity(docs, known)
    scored = docs.select("doc_id", toxicity.toxicity_score(model, docs["text"]).alias("s")).collect()
    for row in scored:
        assert (row["s"]["score"] >= 0.7) == bool(rows[row["doc_id"]][2])
        assert bool(row["s"]["evidence"]) == bool(rows[row["doc_id"]][2])


def test_toxicity_edges(spark, edge_docs):
    none = spark.createDataFrame([], "doc_id bigint, label int")
    model = toxicity.fit_toxicity(edge_docs, none)
    scores = [r["s"]["score"] for r in edge_docs.select(toxicity.toxicity_score(model, edge_docs["text"]).alias("s")).collect()]
    assert scores == [0.5] * 10
    odd = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (7, None), (7, 0), (99, 1)], "doc_id bigint, label int")
    model = toxicity.fit_toxicity(edge_docs, odd)
    assert 0 <= model.without <= 1
    empty = edge_docs.where("false")
    assert empty.select(toxicity.toxicity_score(toxicity.fit_toxicity(empty, odd), empty["text"])).count() == 0


def test_monotone():
    x, y = toxicity.monotone(np.array([0.1, 0.2, 0.3, 0.3, 0.9]), np.array([0, 1, 0, 0, 1.0]))
    assert np.all(np.diff(x) >= 0) and np.all(np.diff(y) >= 0) and x[0] == 0 and x[-1] == 1


# Quality classifier


def test_pairs_are_learned():
    rng = np.random.default_rng(2)
    x = rng.random((4000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.fit(x, y)
    assert (0, 1) in model.pairs
    fresh = rng.random((1000, 3))
    assert (((fresh[:, 0] > 0.5) ^ (fresh[:, 1] > 0.5)) == (model.score(fresh) > 0.5)).mean() > 0.93


def test_constant_models():
    assert quality.fit(np.zeros((0, 14)), np.zeros(0)).score(np.zeros((2, 14))).tolist() == [0.5, 0.5]
    assert quality.fit(np.ones((5, 14)), np.ones(5)).score(np.zeros((1, 14)))[0] > 0.8


def test_features_are_finite():
    for text in ["", " ", "a", "ß" * 5000, "\n\n", "x" * 100_000, "A B\nA B\n1 2 !!"]:
        assert len(quality.text_features(text)) == len(quality.FEATURES)
        assert all(map(math.isfinite, quality.text_features(text)))


def test_quality_edges(spark, edge_docs):
    odd = spark.createDataFrame([(5, 1), (5, 0), (None, 1), (6, None), (7, 0)], "doc_id bigint, label int")
    model = quality.fit_quality(edge_docs, odd)
    scores = edge_docs.select("doc_id", quality.quality_score(model, edge_docs["text"]).alias("s")).collect()
    by_id = {r["doc_id"]: r["s"] for r in scores}
    assert len(scores) == 10 and all(0 <= s <= 1 for s in by_id.values()) and by_id[1] == by_id[2] == by_id[3]
    empty = edge_docs.where("false")
    assert empty.select(quality.quality_score(quality.fit_quality(empty, odd), empty["text"])).count() == 0


@pytest.mark.parametrize(("name", "label", "least"), [("op1_toxicity", "toxic", 0.9), ("op5_quality_classifier", "quality", 0.95)])
def test_held_out_accuracy(spark, name, label, least):
    from postsift import llm

    known = {r["doc_id"]: r[label] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    folds = {"toxic": (3, 1), "quality": (5, 0)}[label]
    found = llm.queries()[name](spark, SF).collect()
    assert len(found) == 1000
    for row in found:
        assert row["held_out"] == (zlib.crc32(str(row["doc_id"]).encode()) % folds[0] == folds[1])
    held = [r for r in found if r["held_out"] and r["doc_id"] in known]
    assert sum(r["predicted"] == known[r["doc_id"]] for r in held) / len(held) >= least


# Quality rules


def brute_rules(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    twice = {w for w in windows if windows.count(w) > 1} if len(windows) < 500 else set()
    covered = {i + k for i, w in enumerate(windows) if w in twice for k in range(5)}
    failed = len(words) < 10 or 100 * len(covered) > 20 * len(words)
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)),
        len(covered), failed,
    )


COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]


def test_rule_counts(spark):
    random.seed(9)
    texts = [None, "", " \n\n ", "a b c d e a b c d e", "x " * 40, "a\na\n a\n\n\nb#*", "é\U0001f600 & <b> | 中"]
    texts += ["".join(random.choice(["a ", "b ", "c\n", "d\t", "\x0b", "#", "é "]) for _ in range(random.randint(0, 120))) for _ in range(80)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    found = rules.quality_rules(docs, [0] * rules.BUCKETS).collect()
    assert {r["doc_id"]: tuple(r[c] for c in COUNTS) for r in found} == {i: brute_rules(t) for i, t in enumerate(texts)}
    assert all(r["kept"] == (not r["base_failed"]) for r in found)


def test_ratio(spark):
    docs = spark.createDataFrame([(1, "a b c"), (2, "a b"), (3, "z z z z"), (None, "q")], "doc_id bigint, text string")
    trusted = spark.createDataFrame([(1,), (1,), (None,)], "doc_id bigint")
    found = rules.ratio_table(docs, trusted, 97)
    raw, target = [1] * 97, [1] * 97

    def buckets(text):
        sums = [zlib.crc32(w.encode()) for w in text.split()]
        return [s % 97 for s in sums] + [(a * rules.PAIR + b) % 97 for a, b in zip(sums, sums[1:])]

    for doc_id, text in [(1, "a b c"), (2, "a b"), (3, "z z z z"), (None, "q")]:
        for bucket in buckets(text):
            raw[bucket] += 1
            target[bucket] += doc_id == 1
    want = [round(1e6 * (math.log(t / sum(target)) - math.log(r / sum(raw)))) for t, r in zip(target, raw)]
    assert all(abs(a - b) <= 1 for a, b in zip(found, want))
    scored = {r["doc_id"]: r for r in rules.quality_rules(docs, found).collect()}
    assert scored[1]["llr_sum"] == sum(found[b] for b in buckets("a b c")) and scored[1]["n_grams"] == 5


def test_rule_edges(spark, edge_docs):
    empty = edge_docs.where("false")
    trusted = spark.createDataFrame([(5,)], "doc_id bigint")
    ratios = rules.ratio_table(edge_docs, trusted)
    found = rules.quality_rules(edge_docs, ratios).collect()
    assert len(found) == 10 and sum(r["doc_id"] == 7 for r in found) == 2
    assert all(r["base_failed"] and not r["kept"] and r["n_words"] == 0 for r in found if r["doc_id"] in (1, 2, 3))
    assert set(rules.ratio_table(empty, trusted)) == {0}
    assert rules.quality_rules(empty, ratios).count() == 0


def test_rules_use_no_python(spark, edge_docs):
    plan = rules.quality_rules(edge_docs, [0] * 10)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
