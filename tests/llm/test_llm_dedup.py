"""Span, near-duplicate and byte string dedup against brute force."""

import hashlib
import random

import numpy as np
import pytest

from postsift.llm import op02_sentence_spans as spans
from postsift.llm import op03_minhash_dedup as minhash
from postsift.llm import op04_suffix_dedup as suffix
from postsift.llm.components import components

from .brute import brute_bytes, brute_components


def docs_of(spark, texts):
    return spark.createDataFrame(list(texts), "doc_id bigint, text string").repartition(3)


# Connected components


def test_components(spark):
    pairs = [(5, 4), (4, 3), (3, 2), (9, 8), (8, 9), (7, 7), (12, 11), (11, 10), (10, 2), (None, 3)]
    found = components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()
    assert {(r["node"], r["root"]) for r in found} == {(3, 2), (4, 2), (5, 2), (10, 2), (11, 2), (12, 2), (9, 8)}


def test_no_components(spark):
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


# Sentence spans


def brute_spans(docs, run, least):
    kept, seen = {}, {}
    order = sorted(docs)
    for doc_id, text in order:
        found = spans.sentences(text or "")
        for i in range(len(found) - run + 1):
            if sum(len(s.split(b" ")) for s in found[i : i + run]) >= least:
                seen.setdefault(tuple(found[i : i + run]), []).append((doc_id, i))
    gone = {(d, i + k) for places in seen.values() for d, i in places[1:] for k in range(run)}
    for doc_id, text in order:
        out, at = [], 0
        for piece in spans.pieces(text or ""):
            if piece.split():
                if (doc_id, at) not in gone:
                    out.append(piece)
                at += 1
            else:
                out.append(piece)
        kept[doc_id] = (at, sum(d == doc_id for d, _ in gone), "".join(out))
    return kept


@pytest.mark.parametrize("run", [2, 3])
def test_sentence_spans(spark, run):
    random.seed(run)
    base = [" ".join(random.choice("abcdef") * random.randint(1, 2) for _ in range(random.randint(1, 5))) for _ in range(6)]
    docs = [
        (i, "".join(random.choice(base) + random.choice([". ", "!\n", "\n\n", "? "]) for _ in range(random.randint(0, 9))))
        for i in range(60)
    ]
    found = spans.remove_repeated_sentences(docs_of(spark, docs), run=run, min_words=3).collect()
    assert {r["doc_id"]: (r["n_sentences"], r["n_removed"], r["text"]) for r in found} == brute_spans(docs, run, 3)


def test_sentence_span_edges(spark, edge_docs):
    found = {}
    for row in spans.remove_repeated_sentences(edge_docs).collect():
        found.setdefault(row["doc_id"], []).append(row)
    assert len(found[7]) == 2 and found[7][0] == found[7][1]
    assert [found[i][0]["n_removed"] for i in (1, 2, 3, 4, 6, 7, 9)] == [0, 0, 0, 0, 0, 2, 0]
    assert [found[i][0]["text"] for i in (1, 2, 3, 7)] == ["", "", " \t\n ", ""]
    assert found[None][0]["n_sentences"] == 1
    assert spans.remove_repeated_sentences(edge_docs.where("false")).count() == 0


# Near-duplicates


def near_copies(seed, groups, copies, size, edits):
    """Groups of an original and edited copies, which are often linked to the original alone."""
    random.seed(seed)
    docs = []
    for _ in range(groups):
        words = [f"w{random.randint(0, 10_000)}" for _ in range(size)]
        texts = [words]
        for _ in range(copies):
            copy = list(words)
            for _ in range(random.randint(0, edits)):
                copy[random.randrange(size)] = f"x{random.randint(0, 10_000)}"
            texts.append(copy)
        docs += [" ".join(t) for t in texts]
    random.shuffle(docs)
    return list(enumerate(docs))


@pytest.mark.parametrize(("words", "seed"), [(2, 1), (5, 2)])
def test_near_duplicates(spark, words, seed):
    docs = near_copies(seed, 6, 25, 120, 12 if words == 2 else 5)
    found = minhash.near_duplicates(docs_of(spark, docs), words=words).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == brute_components(docs, words)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in found)


def test_one_large_group(spark):
    docs = near_copies(3, 1, 300, 150, 14)
    found = minhash.near_duplicates(docs_of(spark, docs), words=2).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == brute_components(docs, 2)


def test_members_of_a_large_group_leave_its_buckets(spark, monkeypatch):
    """Rows that stay in buckets with more than one component, over all rounds."""
    opened, mixed = [], minhash._mixed

    def counted(labelled):
        opened.append(mixed(labelled).count())
        return mixed(labelled)

    monkeypatch.setattr(minhash, "_mixed", counted)
    docs = near_copies(4, 1, 300, 150, 24)
    found = minhash.near_duplicates(docs_of(spark, docs), words=2).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == brute_components(docs, 2)
    assert sum(opened) < 24 * len(docs), opened


def test_excerpts_of_one_text(spark):
    """Sets inside the centre's, of many sizes: linked with each other, though not with the centre."""
    random.seed(9)
    words = [f"w{i}" for i in range(200)]
    docs = []
    for _ in range(60):
        start, length = random.randint(0, 120), random.randint(60, 200)
        docs.append(" ".join(words[start : start + length] + [f"x{random.randint(0, 50)}"] * random.randint(0, 1)))
    docs = list(enumerate(docs))
    found = minhash.near_duplicates(docs_of(spark, docs), words=2).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == brute_components(docs, 2)


def test_near_duplicate_edges(spark, edge_docs):
    found = {}
    for row in minhash.near_duplicates(edge_docs).collect():
        found.setdefault(row["doc_id"], []).append(row)
    assert [found[i][0]["component_id"] for i in (1, 2, 3, 4, 5, 6, 7, 9)] == [1, 2, 3, 4, 5, 6, 6, 9]
    assert len(found[7]) == 2 and not found[7][0]["kept"]
    assert found[1][0]["n_shingles"] == 0 and found[4][0]["n_shingles"] == 1
    assert found[None][0]["component_id"] is None and found[None][0]["kept"]
    assert minhash.near_duplicates(edge_docs.where("false")).count() == 0


def test_signature_estimates_similarity():
    a, b = np.arange(0, 1000, dtype=np.uint64), np.arange(200, 1200, dtype=np.uint64)
    same = (minhash.signature(a, 2000) == minhash.signature(b, 2000)).mean()
    assert abs(same - 800 / 1200) < 0.05


# Byte strings


@pytest.mark.parametrize(("length", "chunk"), [(20, 300), (20, 100_000), (7, 200)])
def test_repeated_bytes(spark, length, chunk):
    random.seed(length + chunk)
    base = ["".join(random.choice("abcd é") for _ in range(60)) for _ in range(8)]
    texts = [None, "", "a" * 90, "ab" * 40, "a" * 30, "".join(random.choice(base) for _ in range(30))]
    texts += [
        "".join(random.choice(base)[random.randint(0, 20) : random.randint(20, 60)] + random.choice("xyz") for _ in range(random.randint(1, 6)))
        for _ in range(60)
    ]
    random.shuffle(texts)
    docs = list(enumerate(texts))
    found = suffix.remove_repeated_bytes(docs_of(spark, docs), length=length, chunk_bytes=chunk, bucket_bytes=500)
    assert sorted(map(tuple, found.collect())) == brute_bytes(docs, length)


def test_repeated_byte_edges(spark, edge_docs):
    found = {}
    for row in suffix.remove_repeated_bytes(edge_docs, length=30).collect():
        found.setdefault(row["doc_id"], []).append(row)
    empty = hashlib.sha256(b"").hexdigest()
    assert [found[i][0]["kept_sha256"] for i in (1, 2)] == [empty, empty]
    assert found[6][0]["n_removed"] == 0
    # Rows that repeat an id count one after the other.
    assert [r["n_removed"] for r in found[7]] == [found[7][0]["n_bytes"]] * 2
    assert found[None][0]["n_removed"] == 0
    assert suffix.remove_repeated_bytes(edge_docs.where("false")).count() == 0
