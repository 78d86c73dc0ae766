"""Quality classifier: a generalised additive model with pairwise interactions.

Texts become a few numbers, each cut into bins. Boosted shallow trees are learned one feature at a
time in turn, then for the pairs of features that explain most of what is left. All trees of a
feature, or pair, add up to one lookup table, so a score is a sum of table entries.

The model is fitted on a bounded sample of labelled rows (``max_rows``, those of the lowest id
hash); every document is scored from its whole text, in the scan, without a shuffle.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import parts, whole

MAX_ROWS = 20_000
BINS = 32
ROUNDS = 120
PAIR_ROUNDS = 40
PAIRS = 8
RATE = 0.1
# Least sum of second derivatives in a leaf, and what is added to it.
LEAF = 2.0
RIDGE = 1.0

FEATURES = [
    "log_words", "word_chars", "symbols", "upper", "digits", "stops", "exclaims", "distinct_words",
    "top_word", "distinct_pairs", "dup_lines", "line_chars", "short_words", "non_ascii",
]

_SYMBOLS = np.frombuffer(b"#*$%&|<>", np.uint8)
_STOPS = np.frombuffer(b".,;:?", np.uint8)


def text_features(text: str) -> list[float]:
    """The numbers of one text, all finite; zeros for a text without words."""
    data = text.encode("utf-8", "replace")
    words = data.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    size = len(data)
    upper, lower = int(counts[65:91].sum()), int(counts[97:123].sum())
    seen = Counter(words)
    lines = [line for line in data.split(b"\n") if line.strip()]
    return [
        math.log1p(n),
        min(sum(map(len, words)) / n, 100.0),
        float(counts[_SYMBOLS].sum()) / size,
        upper / max(upper + lower, 1),
        float(counts[48:58].sum()) / size,
        float(counts[_STOPS].sum()) / n,
        float(counts[33]) / n,
        len(seen) / n,
        max(seen.values()) / n,
        len(set(zip(words, words[1:], strict=False))) / max(n - 1, 1),
        1 - len(set(lines)) / len(lines),
        math.log1p(size / len(lines)),
        sum(len(word) <= 3 for word in words) / n,
        float(counts[128:].sum()) / size,
    ]


def _matrix(texts: pd.Series) -> np.ndarray:
    return np.array([text_features(text) for text in texts], float).reshape(len(texts), len(FEATURES))


@dataclass
class Additive:
    """Log odds as a sum of table entries: one table per feature, one per chosen pair."""

    intercept: float
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        columns = [np.searchsorted(edge, x[:, i], side="right") for i, edge in enumerate(self.edges)]
        return np.stack(columns, 1) if columns else np.zeros((len(x), 0), int)

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        b = self.bins(x)
        total = np.full(len(x), self.intercept)
        for i, table in enumerate(self.tables):
            total += table[b[:, i]]
        for (i, j), table in zip(self.pairs, self.pair_tables, strict=True):
            total += table[b[:, i], b[:, j]]
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.log_odds(x)))


def _best_cut(g: np.ndarray, h: np.ndarray) -> tuple[float, int]:
    """Gain and place of the best cut of a histogram; gain 0 if no cut is allowed."""
    left_g, left_h = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    right_g, right_h = g.sum() - left_g, h.sum() - left_h
    gain = left_g**2 / (left_h + RIDGE) + right_g**2 / (right_h + RIDGE) - g.sum() ** 2 / (h.sum() + RIDGE)
    gain = np.where((left_h >= LEAF) & (right_h >= LEAF), gain, 0.0)
    if not len(gain):
        return 0.0, 0
    best = int(np.argmax(gain))
    return float(gain[best]), best + 1


def _tree(g: np.ndarray, h: np.ndarray, depth: int = 2) -> np.ndarray:
    """Values per bin of a shallow tree on gradient and curvature histograms."""
    gain, cut = _best_cut(g, h) if depth else (0.0, 0)
    if gain <= 1e-9:
        return np.full(len(g), g.sum() / (h.sum() + RIDGE))
    return np.concatenate([_tree(g[:cut], h[:cut], depth - 1), _tree(g[cut:], h[cut:], depth - 1)])


def _pair_tree(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Values per cell of a tree that cuts one feature, then the other on each side."""
    best, out = -1.0, None
    for turned in (False, True):
        a, b = (g.T, h.T) if turned else (g, h)
        _, cut = _best_cut(a.sum(1), b.sum(1))
        sides = [(a[:cut], b[:cut]), (a[cut:], b[cut:])] if cut else [(a, b)]
        values, gain = np.zeros_like(a), 0.0
        at = 0
        for x, y in sides:
            leaf = _tree(x.sum(0), y.sum(0), 1)
            values[at : at + len(x)] = leaf
            gain += float((leaf * x.sum(0)).sum())
            at += len(x)
        if gain > best:
            best, out = gain, values.T if turned else values
    return out


def fit(x: np.ndarray, y: np.ndarray) -> Additive:
    """Fits on rows of features and labels 0 or 1; without both labels the score is constant."""
    positive = float(y.sum())
    prior = (positive + 1) / (len(y) + 2)
    model = Additive(math.log(prior / (1 - prior)))
    if positive in (0.0, float(len(y))):
        return model
    for i in range(x.shape[1]):
        cuts = np.quantile(x[:, i], np.linspace(0, 1, BINS + 1)[1:-1])
        model.edges.append(np.unique(cuts))
        model.tables.append(np.zeros(len(model.edges[i]) + 1))
    b = model.bins(x)
    total = np.full(len(y), model.intercept)

    def derivatives() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for i, table in enumerate(model.tables):
            g, h = derivatives()
            size = len(table)
            step = RATE * _tree(np.bincount(b[:, i], g, size), np.bincount(b[:, i], h, size))
            table += step
            total += step[b[:, i]]
    g, h = derivatives()
    cells = {(i, j): b[:, i] * len(model.tables[j]) + b[:, j] for i, j in combinations(range(x.shape[1]), 2)}

    def pair_step(pair: tuple[int, int], g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
        shape = (len(model.tables[pair[0]]), len(model.tables[pair[1]]))
        size = shape[0] * shape[1]
        grid = np.bincount(cells[pair], g, size).reshape(shape), np.bincount(cells[pair], h, size).reshape(shape)
        values = _pair_tree(*grid)
        return values, float((values * grid[0]).sum())

    strength = {pair: pair_step(pair, g, h)[1] for pair in cells}
    model.pairs = sorted(strength, key=lambda pair: (-strength[pair], pair))[:PAIRS]
    model.pair_tables = [np.zeros((len(model.tables[i]), len(model.tables[j]))) for i, j in model.pairs]
    for _ in range(PAIR_ROUNDS):
        for pair, table in zip(model.pairs, model.pair_tables, strict=True):
            g, h = derivatives()
            step = RATE * pair_step(pair, g, h)[0]
            table += step
            total += step.reshape(-1)[cells[pair]]
    return model


def fit_quality(docs: DataFrame, labelled: DataFrame, *, max_rows: int = MAX_ROWS) -> Additive:
    """A model from ``docs`` (doc_id, text) and ``labelled`` (doc_id, label 0 or 1).

    At most ``max_rows`` labelled ids are used, those of the lowest hash. Null ids and labels are
    left out; of a repeated id the larger label counts. Nothing but the text is an input.
    """
    chosen = (
        labelled.where("doc_id IS NOT NULL AND label IN (0, 1)")
        .groupBy("doc_id").agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    )
    numbers = F.pandas_udf(lambda texts: pd.Series(list(_matrix(texts))), T.ArrayType(T.DoubleType()))
    rows = (
        docs.select("doc_id", whole("text").alias("text"))
        .join(F.broadcast(chosen), "doc_id")  # at most max_rows pairs of numbers
        .select("doc_id", "label", numbers("text").alias("x"))
        .orderBy("doc_id", "x").limit(2 * max_rows)  # repeated rows of an id can't add without bound
        .collect()
    )
    x = np.array([row["x"] for row in rows], float).reshape(len(rows), len(FEATURES))
    return fit(x, np.array([row["label"] for row in rows], float))


def quality_score(model: Additive, text: Column) -> Column:
    """The score of a text between 0 and 1; a null text scores like an empty one."""

    @F.pandas_udf(T.DoubleType())
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in (part for batch in batches for part in parts(batch)):
            yield pd.Series(model.score(_matrix(texts)), dtype=float)

    return score(whole(text))
