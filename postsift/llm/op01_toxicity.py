"""Toxicity: votes of the nearest labelled examples by exact TF-IDF cosine.

Terms are words and beginnings of words. Those that tell the labels apart are chosen on
the examples, their document frequencies are counted over all documents. Examples lie in an inverted
index whose postings are cut into blocks of neighbouring examples with the largest weight of each:
blocks are visited by falling bound and left out once they can't reach the nearest found, so the
result is that of comparing with every example.

Votes are weighted by similarity, with a prior vote against little evidence, and calibrated by a
monotone fit on the examples' own votes, each without itself. A document without any chosen term
gets the share of toxic examples without one.

Examples are a bounded sample (``max_examples`` labelled rows of the lowest id hash) that is sent to
the executors; every document is scored from its whole text, in the scan.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postsift.storage import written

from .common import whole

MAX_EXAMPLES = 20_000
MAX_TERMS = 2_048
# A term is chosen if so many toxic examples hold it, and so large a share of its examples is toxic.
MIN_TOXIC = 5
MIN_SHARE = 0.75
PREFIXES = (3, 4, 5, 6)
NEAREST = 15
PRIOR = 0.3
BLOCK = 64
EVIDENCE = 3

SCORED = "struct<score:double,evidence:string>"

# Signs around a word that are not part of it.
_SIGNS = ".,;:!?#*$%&|<>\"'()[]{}"
_KEPT_WORDS = 500_000


def word_terms(word: str) -> tuple[str, ...]:
    """Terms of one word in lower case: the word itself, and its beginnings of some lengths."""
    word = word.strip(_SIGNS)
    if not word:
        return ()
    return (word, *(f"{word[:n]}*" for n in PREFIXES if len(word) > n))


class _Known(dict):
    """Numbers of the chosen terms of a word; forgets all when it holds too many words."""

    def __init__(self, numbers: dict[str, int]):
        super().__init__()
        self._numbers = numbers

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) > _KEPT_WORDS:
            self.clear()
        found = tuple(self._numbers[term] for term in word_terms(word) if term in self._numbers)
        self[word] = found
        return found


def term_counts(text: str, known: _Known) -> dict[int, int]:
    found = [numbers for numbers in map(known.__getitem__, text.lower().split()) if numbers]
    return Counter(number for numbers in found for number in numbers)


def _vector(counts: dict[int, int], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Term numbers and weights of length one, in order of numbers."""
    terms = np.array(sorted(counts), int)
    weights = np.array([1 + math.log(counts[t]) for t in terms.tolist()]) * idf[terms] if len(terms) else np.zeros(0)
    norm = math.sqrt(float((weights**2).sum()))
    return (terms, weights / norm) if norm > 0 else (terms[:0], weights[:0])


@dataclass
class Index:
    """Blocks of examples in term order: per term and block the largest weight, per block the postings."""

    ids: np.ndarray
    labels: np.ndarray
    largest: np.ndarray
    postings: list[dict[int, tuple[np.ndarray, np.ndarray]]]

    @staticmethod
    def build(vectors: list[tuple[np.ndarray, np.ndarray]], ids: list, labels: list[int], terms: int) -> Index:
        # Examples of the same strongest term are neighbours, which keeps the bounds tight.
        order = sorted(range(len(vectors)), key=lambda i: (int(vectors[i][0][np.argmax(vectors[i][1])]), ids[i]))
        blocks = -(-len(order) // BLOCK)
        largest, postings = np.zeros((terms, blocks)), []
        for b in range(blocks):
            lists: dict[int, list[tuple[int, float]]] = {}
            for place, i in enumerate(order[b * BLOCK : (b + 1) * BLOCK]):
                for term, weight in zip(*vectors[i], strict=True):
                    lists.setdefault(int(term), []).append((place, float(weight)))
            postings.append({
                t: (np.array([p for p, _ in row]), np.array([w for _, w in row])) for t, row in lists.items()
            })
            for t, (_, weights) in postings[b].items():
                largest[t, b] = weights.max()
        return Index(np.array([ids[i] for i in order]), np.array([labels[i] for i in order], float), largest, postings)

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int, leave: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Places and cosines of the k nearest examples with a cosine above 0; ties by place.

        ``leave`` is a place that doesn't count.
        """
        bounds = weights @ self.largest[terms]
        places, cosines, least = np.zeros(0, int), np.zeros(0), 0.0
        for b in np.argsort(-bounds, kind="stable"):
            if bounds[b] <= 0 or (len(places) == k and bounds[b] < least - 1e-12):
                break
            scores = np.zeros(BLOCK)
            for term, weight in zip(terms.tolist(), weights, strict=True):
                if term in self.postings[b]:
                    at, held = self.postings[b][term]
                    scores[at] += weight * held
            hit = np.flatnonzero(scores > 0)
            here = hit + b * BLOCK
            if leave >= 0:
                hit, here = hit[here != leave], here[here != leave]
            places, cosines = np.concatenate([places, here]), np.concatenate([cosines, scores[hit]])
            best = np.lexsort((places, -np.round(cosines, 12)))[:k]
            places, cosines = places[best], cosines[best]
            least = float(cosines[-1]) if len(cosines) else 0.0
        return places, cosines


@dataclass
class Toxicity:
    """Everything that scoring needs; its size depends on the examples and terms alone."""

    numbers: dict[str, int]
    idf: np.ndarray
    index: Index
    without: float
    share: float
    steps: tuple[np.ndarray, np.ndarray]

    def vote(self, places: np.ndarray, cosines: np.ndarray) -> float:
        return float(((cosines * self.index.labels[places]).sum() + PRIOR * self.share) / (cosines.sum() + PRIOR))

    def score(self, counts: dict[int, int]) -> tuple[float, str]:
        terms, weights = _vector(counts, self.idf)
        if not len(terms):
            return self.without, ""
        places, cosines = self.index.nearest(terms, weights, NEAREST)
        if not len(places):
            return self.without, ""
        score = float(np.interp(self.vote(places, cosines), *self.steps))
        near = [f"{self.index.ids[p]}:{c:.4f}" for p, c in zip(places[:EVIDENCE], cosines[:EVIDENCE], strict=True)]
        return score, ",".join(near)


def monotone(votes: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Points of a rising step fit of labels on votes: pool neighbours until shares rise."""
    order = np.argsort(votes, kind="stable")
    pools: list[list[float]] = []
    for x, y in zip(votes[order], labels[order], strict=True):
        pools.append([x, y, 1.0])
        while len(pools) > 1 and (pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2] or pools[-2][0] == pools[-1][0]):
            x2, y2, n2 = pools.pop()
            pools[-1] = [(pools[-1][0] * pools[-1][2] + x2 * n2) / (pools[-1][2] + n2), pools[-1][1] + y2, pools[-1][2] + n2]
    if not pools:
        return np.array([0.0, 1.0]), np.array([0.0, 1.0])
    # A small slope of the vote itself keeps the order of votes within a pool.
    x = np.array([p[0] for p in pools])
    y = np.array([(p[1] + 0.5) / (p[2] + 1) for p in pools])
    return np.concatenate([[0.0], x, [1.0]]), np.concatenate([[min(y[0], 0.001)], np.maximum.accumulate(y), [max(y[-1], 0.999)]])


def _example_terms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for rows in batches:
        terms, toxic = [], []
        for text, label in zip(rows["text"], rows["label"], strict=True):
            held = {term for word in set(text.lower().split()) for term in word_terms(word)}
            terms.extend(held)
            toxic.extend([label] * len(held))
        yield pd.DataFrame({"term": terms, "toxic": toxic}).astype({"term": object, "toxic": "int64"})


def _frequencies(numbers: dict[str, int]):
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, totals, docs = _Known(numbers), Counter(), 0
        for rows in batches:
            docs += len(rows)
            for text in rows["text"]:
                totals.update(term_counts(text, known).keys())
        yield pd.DataFrame({"term": [-1, *totals.keys()], "n": [docs, *totals.values()]}).astype("int64")

    return count


def fit_toxicity(docs: DataFrame, labelled: DataFrame, *, max_examples: int = MAX_EXAMPLES, max_terms: int = MAX_TERMS) -> Toxicity:
    """A model from ``docs`` (doc_id, text) and ``labelled`` (doc_id, label 0 or 1).

    Null ids and labels are left out; of a repeated id the larger label counts, of its rows one.
    Document frequencies are those of all rows of ``docs``. Without examples every score is 0.5.
    """
    chosen = (
        labelled.where("doc_id IS NOT NULL AND label IN (0, 1)")
        .groupBy("doc_id").agg(F.max("label").cast("bigint").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_examples)
    )
    texts = docs.select("doc_id", whole("text").alias("text"))
    examples = written(texts.join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"]))  # of bounded rows
    held = examples.select("text", "label").mapInPandas(_example_terms, "term string, toxic bigint")
    counted = held.groupBy("term").agg(F.sum("toxic").alias("toxic"), F.count("*").alias("n"))
    telling = counted.where((F.col("toxic") >= MIN_TOXIC) & (F.col("toxic") >= MIN_SHARE * F.col("n")))
    best = telling.orderBy(F.desc(F.col("toxic") * F.col("toxic") / F.col("n")), "term").limit(max_terms).collect()
    numbers = {row["term"]: i for i, row in enumerate(best)}
    frequency = {
        row["term"]: row["n"]
        for row in texts.select("text").mapInPandas(_frequencies(numbers), "term bigint, n bigint")
        .groupBy("term").agg(F.sum("n").alias("n")).collect()  # one row per chosen term
    }
    total = frequency.get(-1, 0)
    idf = np.array([math.log((total + 1) / (frequency.get(i, 0) + 1)) + 1 for i in range(len(numbers))])

    @F.pandas_udf("array<struct<term:int,n:int>>")
    def counts_of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = _Known(numbers)
        for rows in batches:
            yield pd.Series(
                [[{"term": t, "n": n} for t, n in sorted(term_counts(text, known).items())] for text in rows], dtype=object
            )

    rows = examples.select("doc_id", "label", counts_of("text").alias("counts")).orderBy("doc_id").collect()
    labels = np.array([row["label"] for row in rows], float)
    vectors = [_vector({x["term"]: x["n"] for x in row["counts"]}, idf) for row in rows]
    some = [i for i, (terms, _) in enumerate(vectors) if len(terms)]
    none = labels[[i for i, (terms, _) in enumerate(vectors) if not len(terms)]]
    index = Index.build([vectors[i] for i in some], [rows[i]["doc_id"] for i in some], [int(labels[i]) for i in some], len(numbers))
    share = float((labels.sum() + 1) / (len(labels) + 2))
    model = Toxicity(numbers, idf, index, float((none.sum() + 1) / (len(none) + 2)), share, (np.array([0.0, 1.0]),) * 2)
    votes = []
    at = {int(doc_id): place for place, doc_id in enumerate(index.ids)}
    for i in some:
        place = at[int(rows[i]["doc_id"])]
        votes.append(model.vote(*index.nearest(*vectors[i], NEAREST, leave=place)))
    model.steps = monotone(np.array(votes), labels[some])
    return model


def toxicity_score(model: Toxicity, text: Column) -> Column:
    """Score between 0 and 1 and the nearest examples as id:cosine; null scores like empty."""

    @F.pandas_udf(SCORED)
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = _Known(model.numbers)
        for texts in batches:
            rows = [model.score(term_counts(text, known)) for text in texts]
            yield pd.DataFrame(rows, columns=["score", "evidence"]).astype({"score": float, "evidence": object})

    return score(whole(text))
