"""Benchmark decontamination: MinHash containment search, items partitioned by size.

An item is found in a document if the document holds at least 80 % of the item's shingles of five
words. Items are short and documents long, so a document's own MinHash says nothing about an item.
Each item is sketched instead: a coordinate is the shingle of the item with the smallest value
under one permutation, and it agrees with a document if the document holds that shingle. The share
of coordinates that agree estimates the containment. Items are partitioned by size: those of up to
``COORDINATES`` shingles take every shingle as a coordinate, larger ones, by classes of doubling
size, a fixed number of minima and a threshold that misses a contained item with a probability
below one in a million. A class is only tried on documents large enough to hold its items.
What passes is verified on the exact shingles.

Items are sent to the scan in blocks of bounded size; documents are neither shuffled nor joined.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import parts, whole

WORDS = 5
PERCENT = 80
COORDINATES = 48
# Coordinates that have to agree, of 48: more than six deviations below the mean at 80 %.
AGREE = 20
# Items and bytes of item text that one block holds at most (one longer item is a block).
BLOCK_ITEMS = 20_000
BLOCK_BYTES = 16 << 20

FOUND = "array<struct<item_id:bigint,shared:int,size:int>>"

_STEP = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(33))


def split_words(text: str) -> list[bytes]:
    """Words of a text with A-Z in lower case; blanks are the six of ASCII."""
    return text.encode("utf-8", "replace").lower().split()


def _window_hashes(ids: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Places where n known words follow each other, and a hash for each."""
    if len(ids) < n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    known = ids >= 0
    valid = known[: len(ids) - n + 1].copy()
    for k in range(1, n):
        valid &= known[k : len(ids) - n + 1 + k]
    at = np.flatnonzero(valid)
    h = np.zeros(len(at), np.uint64)
    for k in range(n):
        h = h * _STEP + (ids[at + k] + 1).astype(np.uint64)
    return at, _mix(h + np.uint64(n))


@dataclass
class Item:
    item_id: int | None
    n: int
    shingles: set


class Sketches:
    """The items of one block: their words, shingles and sketches."""

    def __init__(self, items: list[tuple[int | None, str]], words: int = WORDS, percent: int = PERCENT):
        self.percent = percent
        split = [(item_id, split_words(text)) for item_id, text in items]
        vocabulary = sorted({word for _, ws in split for word in ws})
        self.ids = {word: i for i, word in enumerate(vocabulary)}
        self.items: list[Item] = []
        seeds = _mix(_STEP * np.arange(1, COORDINATES + 1, dtype=np.uint64))
        keys, owners, weights, sizes, needed = [], [], [], [], []
        for item_id, ws in split:
            if not ws:
                continue
            n = min(words, len(ws))
            ids = np.array([self.ids[word] for word in ws])
            at, hashes = _window_hashes(ids, n)
            hashes = np.unique(hashes)
            shingles = {tuple(ids[i : i + n].tolist()) for i in at}
            if len(hashes) <= COORDINATES:
                chosen, counts, need = hashes, np.ones(len(hashes), int), -(-percent * len(hashes) // 100)
            else:
                minima = [hashes[np.argmin(_mix(hashes ^ seeds[k]))] for k in range(COORDINATES)]
                chosen, counts = np.unique(np.array(minima, np.uint64), return_counts=True)
                need = AGREE
            number = len(self.items)
            self.items.append(Item(item_id, n, shingles))
            keys.append(chosen)
            owners.append(np.full(len(chosen), number))
            weights.append(counts)
            sizes.append(len(shingles))
            needed.append(need)
        self.keys = np.concatenate([np.zeros(0, np.uint64), *keys])
        order = np.argsort(self.keys, kind="stable")
        self.keys = self.keys[order]
        self.owners = np.concatenate([np.zeros(0, int), *owners])[order]
        self.weights = np.concatenate([np.zeros(0, int), *weights])[order]
        self.sizes, self.needed = np.array(sizes, int), np.array(needed, int)
        # Size classes by doubling; a class needs so many words in a document.
        self.least = (2 ** np.floor(np.log2(np.maximum(self.sizes, 1))) * percent / 100).astype(int)
        self.lengths = sorted({item.n for item in self.items})

    def search(self, texts: list[str]) -> list[list[tuple[int | None, int, int]]]:
        """For every text the items it holds, as (item_id, shingles shared, shingles)."""
        found: list[list] = [[] for _ in texts]
        if not self.items:
            return found
        get = self.ids.get
        rows = [np.fromiter((get(word, -1) for word in split_words(text)), np.int64) for text in texts]
        sizes = np.array([len(row) for row in rows])
        gap = np.array([-1])
        ids = np.concatenate([part for row in rows for part in (row, gap)])
        owner_of = np.repeat(np.arange(len(texts)), sizes + 1)
        hits: list[np.ndarray] = []
        for n in self.lengths:
            at, hashes = _window_hashes(ids, n)
            first, last = np.searchsorted(self.keys, hashes), np.searchsorted(self.keys, hashes, side="right")
            held = np.flatnonzero(last > first)
            if not len(held):
                continue
            spread = last[held] - first[held]
            key = np.repeat(first[held] - np.cumsum(spread) + spread, spread) + np.arange(spread.sum())
            hits.append(np.unique(np.stack([np.repeat(owner_of[at[held]], spread), key], 1), axis=0))
        if not hits:
            return found
        pairs = np.unique(np.concatenate(hits), axis=0)
        code = pairs[:, 0] * len(self.items) + self.owners[pairs[:, 1]]
        codes, inverse = np.unique(code, return_inverse=True)
        agree = np.bincount(inverse, self.weights[pairs[:, 1]])
        text, item = codes // len(self.items), codes % len(self.items)
        for k in np.flatnonzero((agree >= self.needed[item]) & (sizes[text] >= self.least[item])):
            row, one = rows[text[k]], self.items[item[k]]
            at, _ = _window_hashes(row, one.n)
            shared = len(one.shingles & {tuple(row[i : i + one.n].tolist()) for i in at})
            if 100 * shared >= self.percent * len(one.shingles):
                found[text[k]].append((one.item_id, shared, len(one.shingles)))
        return found


def _block_search(sketches: Sketches):
    @F.pandas_udf(FOUND)
    def search(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in (part for batch in batches for part in parts(batch)):
            rows = sketches.search(texts.tolist())
            yield pd.Series(
                [[{"item_id": a, "shared": b, "size": c} for a, b, c in row] for row in rows], dtype=object
            )

    return search


def contained_items(items: DataFrame, text: Column, *, words: int = WORDS, percent: int = PERCENT) -> Column:
    """Items of ``items`` (item_id, text) that a text holds: array of (item_id, shared, size).

    An item of fewer words is one shingle of that length. Items without words, or with a null
    text, are in no document; null documents hold nothing. Repeated items count once. Without
    items the array is empty. The items are read in blocks, each of which is one more search in
    the same scan.
    """
    known = items.select(F.col("item_id").cast("bigint"), whole("text").alias("text")).distinct()
    size = known.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    blocks = max(1, -(-size["n"] // BLOCK_ITEMS), -(-(size["bytes"] or 0) // BLOCK_BYTES))
    parts = []
    for block in range(blocks):
        rows = known.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()
        block_items = sorted(((r["item_id"], r["text"]) for r in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        parts.append(_block_search(Sketches(block_items, words, percent))(whole(text)))
    return F.concat(*parts)


def decontaminate(docs: DataFrame, items: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` that hold none of ``items``, with the columns they had."""
    held = "held_items"
    while held in docs.columns:
        held = f"_{held}"
    return docs.withColumn(held, contained_items(items, F.col("text"), **how)).where(F.size(held) == 0).drop(held)


def containment(docs: DataFrame, items: DataFrame, **how) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_items, items, containment, kept.

    ``items`` lists the ids in ascending order, joined by commas; ``containment`` is the largest
    share found, 0 without items. Repeated rows and null ids stay, further columns are left out.
    """
    found = docs.select("doc_id", contained_items(items, F.col("text"), **how).alias("found"))
    ids = F.array_sort(F.array_distinct(F.transform("found", lambda x: x["item_id"])))
    return found.select(
        "doc_id",
        F.size(ids).cast("bigint").alias("n_items"),
        F.array_join(ids.cast("array<string>"), ",").alias("items"),
        F.coalesce(F.array_max(F.transform("found", lambda x: x["shared"] / x["size"])), F.lit(0.0)).alias("containment"),
        (F.size("found") == 0).alias("kept"),
    )


# Items of fewer than five words, which the given tables don't have, are left out here.
SQL = r"""
WITH words AS (
    SELECT 'd' AS kind, doc_id AS id, regexp_extract_all(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
    UNION ALL
    SELECT 'i', item_id, regexp_extract_all(translate(coalesce(text, ''),
        'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') FROM benchmark
),
shingles AS (
    SELECT DISTINCT kind, id, array_to_string(w[i:i + 4], ' ') AS s FROM words, unnest(range(1, len(w) - 3)) AS u(i)
),
sizes AS (SELECT id, count(*) AS size FROM shingles WHERE kind = 'i' GROUP BY id),
shared AS (
    SELECT d.id AS doc_id, i.id AS item_id, count(*) AS shared
    FROM shingles d JOIN shingles i ON d.kind = 'd' AND i.kind = 'i' AND d.s = i.s GROUP BY ALL
),
found AS (
    SELECT doc_id, item_id, shared / size AS share FROM shared JOIN sizes ON item_id = id
    WHERE 100 * shared >= 80 * size
)
SELECT d.doc_id, count(item_id) AS n_items,
    coalesce(string_agg(item_id::VARCHAR, ',' ORDER BY item_id), '') AS items,
    coalesce(max(share), 0)::DOUBLE AS containment, count(item_id) = 0 AS kept
FROM documents d LEFT JOIN found f ON d.doc_id = f.doc_id GROUP BY d.doc_id
"""
