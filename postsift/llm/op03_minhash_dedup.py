"""MinHash near-duplicates with circulant permutations, banded, and verified on exact sets.

Every text becomes its set of word shingles. One permutation scatters the set, a second one is
shifted by one place per coordinate, so that two permutations give all coordinates. Coordinates are
joined to bands, and documents with an equal band are candidates.

Documents of equal sets are one class and are linked without looking further. Within a band bucket
no pairs are listed. First every bucket has one centre, the member with most company over all
buckets, and all members are compared with it. What is not in one component by then can be linked
in two ways only. Put a member's shingles outside the centre first, rare ones before frequent ones, and
the others behind them: two sets at the threshold share one of their first |x| - ceil(0.8 |x|) + 1
shingles. If that one is outside the centre, the two meet in a bucket of their own for it; if not,
they share no more than the lesser of what each has in common with the centre, and stay in its
buckets only if that can do for one of another component. Which members stay open is found once per
centre, not once per band. Both kinds of buckets are gone through in rounds: some members
are compared with all others that pass, then leave. Rounds go on until every two members of a bucket
are in one component, have been compared, or can't be linked. So a bucket of any size is treated
whole, and what a large group of near copies was compared with once does not keep it in its buckets.

A pair at the threshold shares a band of 40 with a probability of 0.999995.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postsift.storage import written

from .common import parts, whole
from .components import components

BANDS = 40
ROWS = 6
PERCENT = 80
# Members of a bucket that are compared with the others in the first round, at most, and how many
# times more in each further one: a bucket of n that are not linked takes log n rounds.
SLOTS = 64
MORE_SLOTS = 8
# Shingles are told rare from frequent by the counts of 2 ** RARITY_BITS buckets.
RARITY_BITS = 20
# Shingles that are permuted at once.
_BLOCK = 2048
# Hashes of words that a worker keeps.
_KEPT_WORDS = 100_000

SETS = "doc_id long, n_shingles long, set_key binary, bands array<long>"


def _mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _WordHashes(dict):
    """64-bit hashes of words; forgets all when it holds too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > _KEPT_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def shingle_set(text: str, n: int, hashes: _WordHashes) -> np.ndarray:
    """Sorted 64-bit hashes of a text's distinct shingles of n words, A-Z in lower case.

    A text of fewer words is one shingle as a whole, a text without words has none.
    """
    words = text.encode("utf-8", "replace").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    one = np.fromiter((hashes[word] for word in words), np.uint64, len(words))
    size = min(n, len(words))
    mixed = np.full(len(words) - size + 1, size, np.uint64)
    for k in range(size):
        mixed = _mix64(mixed * np.uint64(0x9E3779B97F4A7C15) + one[k : len(words) - size + 1 + k])
    return np.unique(mixed)


def signature(shingles: np.ndarray, coordinates: int) -> np.ndarray:
    """Circulant MinHash: minima of one permutation shifted by one place per coordinate.

    The first one scatters the hashes over the 32-bit numbers, the second is a bijection of these.
    No shingles give no signature.
    """
    scattered = (_mix64(shingles ^ np.uint64(0x2545F4914F6CDD1D)) >> np.uint64(32)).astype(np.uint32)
    shifts = np.arange(coordinates, dtype=np.uint32)
    least = np.full(coordinates, 0xFFFFFFFF, np.uint32)
    for start in range(0, len(scattered), _BLOCK):
        x = scattered[start : start + _BLOCK, None] - shifts
        x ^= x >> np.uint32(16)
        x *= np.uint32(0x85EBCA6B)
        x ^= x >> np.uint32(13)
        x *= np.uint32(0xC2B2AE35)
        x ^= x >> np.uint32(16)
        np.minimum(least, x.min(0), out=least)
    return least


def band_keys(shingles: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """One number per band, different for different bands."""
    grid = signature(shingles, bands * rows).reshape(bands, rows).astype(np.uint64)
    key = np.arange(bands, dtype=np.uint64)
    for k in range(rows):
        key = _mix64(key * np.uint64(0x9E3779B97F4A7C15) + grid[:, k])
    return key.astype(np.int64)


def _sketches(n: int, bands: int, rows: int):
    def sketch(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = _WordHashes()
        for docs in (part for batch in batches for part in parts(batch, "text")):
            out = []
            for doc_id, text in zip(docs["doc_id"], docs["text"], strict=True):
                found = shingle_set(text, n, hashes)
                key = hashlib.blake2b(found.tobytes(), digest_size=16).digest() if len(found) else None
                out.append((doc_id, len(found), key, band_keys(found, bands, rows) if len(found) else None))
            yield pd.DataFrame(out, columns=["doc_id", "n_shingles", "set_key", "bands"]).astype({"doc_id": "Int64"})

    return sketch


def _set_rows(n: int):
    def sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hashes = _WordHashes()
        for docs in (part for batch in batches for part in parts(batch, "text")):
            yield pd.DataFrame({
                "node": docs["doc_id"], "shingles": [shingle_set(text, n, hashes).tobytes() for text in docs["text"]]
            })

    return sets


def _verify(percent: int):
    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pairs in (part for batch in batches for part in parts(batch, "set_a", "set_b")):
            keep = []
            for a, b in zip(pairs["set_a"], pairs["set_b"], strict=True):
                x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pairs.loc[keep, ["a", "b"]]

    return verify


def _bucket(shingles: np.ndarray) -> np.ndarray:
    return (_mix64(shingles) >> np.uint64(64 - RARITY_BITS)).astype(np.int64)


def _bucket_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total = np.zeros(1 << RARITY_BITS, np.int64)
    for sets in batches:
        for shingles in sets["shingles"]:
            np.add.at(total, _bucket(np.frombuffer(shingles, np.uint64)), 1)
    seen = np.flatnonzero(total)
    yield pd.DataFrame({"bucket": seen, "n": total[seen]})


def _frequencies(sets: DataFrame) -> np.ndarray:
    """How many sets hold a shingle of each of a fixed number of buckets, however many sets there are."""
    counted = sets.select("shingles").mapInPandas(_bucket_counts, "bucket long, n long")
    rows = counted.groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    found = np.zeros(1 << RARITY_BITS, np.int64)
    found[rows["bucket"].to_numpy()] = rows["n"].to_numpy()
    return found


def _compare(percent: int, frequencies: Broadcast):
    """Per pair of a centre and a member: linked, shingles shared, the member's first other shingles.

    As many as two sets at the threshold need to share one of, rare ones first: an edit that
    thousands of members have in common comes up only in those with few edits of their own. Any
    order that is the same for all members would do.
    """

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pairs in (part for batch in batches for part in parts(batch, "set_a", "set_b")):
            linked, shared, beyond = [], [], []
            for a, b in zip(pairs["set_a"], pairs["set_b"], strict=True):
                x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
                other = np.setdiff1d(y, x, assume_unique=True)
                both = len(y) - len(other)
                linked.append(100 * both >= percent * (len(x) + len(y) - both))
                shared.append(both)
                first = len(y) + (-percent * len(y)) // 100 + 1
                rare = np.lexsort((other, frequencies.value[_bucket(other)]))
                beyond.append(other[rare[:first]].astype(np.int64))
            yield pd.DataFrame({
                "centre": pairs["a"], "node": pairs["b"], "size": pairs["size"], "company": pairs["company"],
                "linked": linked, "shared": shared, "beyond": beyond,
            })

    return compare


def _with_sets(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    return pairs.join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("set_a")), "a").join(
        sets.select(F.col("node").alias("b"), F.col("shingles").alias("set_b")), "b"
    )


def _best(*columns: str) -> Column:
    return F.min(F.struct((-F.col("company")).alias("order"), *columns)).alias("best")


def _labelled(members: DataFrame, roots: DataFrame | None) -> DataFrame:
    if roots is None:
        return members.withColumn("root", F.col("node"))
    return members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def _mixed(labelled: DataFrame) -> DataFrame:
    """Members of those buckets that hold more than one component."""
    ends = labelled.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"))
    return labelled.join(ends.where("low < high").select("key"), "key", "left_semi")


def _within_reach(known: DataFrame, roots: DataFrame | None, percent: int) -> DataFrame:
    """Members (centre, node, size, shared, root) that may be linked with one of another component inside the centre.

    Two sets that share nothing outside the centre share at most what each shares with it, so a
    member has room for sets up to some size, and either has to have room for the other. The least
    size and the most room are taken of the centre's own component and of all others: where the
    former is large and the others differ much from the centre, few of it are left.
    """
    room = (100 + percent) * F.col("shared") - percent * F.col("size")
    near = known.where(100 * F.col("shared") >= percent * F.col("size")).withColumn("room", room)
    parts = near.groupBy("centre", "root").agg(F.min("size").alias("least"), F.max("room").alias("most"))
    own = _labelled(parts.select(F.col("centre").alias("node")).dropDuplicates(), roots)
    parts = parts.join(own.select(F.col("node").alias("centre"), F.col("root").alias("own")), "centre")
    sides = {"in": F.col("root") == F.col("own"), "out": F.col("root") != F.col("own")}
    ends = parts.groupBy("centre", "own").agg(*[
        end(F.when(side, F.col(name))).alias(f"{name}_{at}")
        for at, side in sides.items() for end, name in ((F.min, "least"), (F.max, "most"))
    ])
    meets = {
        at: (percent * F.col(f"least_{at}") <= F.col("room")) & (F.col(f"most_{at}") >= percent * F.col("size"))
        for at in sides
    }
    return near.join(ends, "centre").where(meets["out"] | (sides["out"] & meets["in"]))


def _roots(found: DataFrame, roots: DataFrame | None) -> DataFrame | None:
    """Components with the links just found."""
    if found.isEmpty():
        return roots
    return components(found if roots is None else found.union(roots.select("node", "root")))


def _linked(docs: DataFrame, classes: DataFrame, n: int, bands: int, rows: int, percent: int, slots: int) -> DataFrame | None:
    """(node, root) of the classes that are linked with others; a class's node is its least id."""
    keys = classes.select(F.col("node"), F.col("n_shingles").alias("size"), F.explode("bands").alias("key"))
    crowded = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    members = written(keys.join(crowded, "key").select("key", "node", "size", "n"))
    company = members.groupBy("node").agg(F.sum("n").alias("company"))
    members = written(members.join(company, "node").select("key", "node", "size", "company"))
    texts = docs.select("doc_id", whole("text").alias("text")).join(
        company.select("node"), F.col("doc_id") == F.col("node"), "left_semi"
    )
    sets = written(texts.mapInPandas(_set_rows(n), "node long, shingles binary"))

    centres = members.groupBy("key").agg(_best("node")).select("key", F.col("best.node").alias("centre"))
    members = written(members.join(centres, "key").where("node <> centre"))
    first = members.select(F.col("centre").alias("a"), F.col("node").alias("b"), "size", "company").dropDuplicates()
    frequencies = docs.sparkSession.sparkContext.broadcast(_frequencies(sets))
    compared = written(_with_sets(first, sets).mapInPandas(
        _compare(percent, frequencies),
        "centre long, node long, size long, company long, linked boolean, shared int, beyond array<long>",
    ))
    roots = _roots(compared.where("linked").select("centre", "node"), None)
    known = written(_mixed(_labelled(compared.drop("linked").withColumn("key", F.col("centre")), roots)).drop("key"))
    by_centre = members.join(
        _within_reach(known, roots, percent).select("centre", "node", "size", "shared"), ["centre", "node", "size"]
    )
    by_shingle = known.withColumn("shingle", F.explode("beyond")).select(
        F.xxhash64("centre", "shingle").alias("key"), "node", "size", "company", F.lit(None).cast("int").alias("shared")
    )
    members = by_centre.select("key", "node", "size", "company", "shared").unionByName(by_shingle)
    while True:
        open_members = written(_mixed(_labelled(members, roots)))
        if open_members.isEmpty():
            return roots
        slot = F.pmod(F.xxhash64("node"), F.lit(slots))
        slots *= MORE_SLOTS
        centres = written(
            open_members.groupBy("key", slot.alias("slot")).agg(_best("node", "size", "root", "shared"))
            .select("key", *[F.col(f"best.{x}").alias(f"centre_{x}") for x in ("node", "size", "root", "shared")])
        )
        most = F.least("shared", "centre_shared")
        enough = F.col("shared").isNull() | F.col("centre_shared").isNull() | (
            (100 + percent) * most >= percent * (F.col("size") + F.col("centre_size"))
        )
        similar = 100 * F.least("size", "centre_size") >= percent * F.greatest("size", "centre_size")
        pairs = (
            open_members.join(centres, "key").where("root <> centre_root").where(similar).where(enough)
            .select(F.least("node", "centre_node").alias("a"), F.greatest("node", "centre_node").alias("b"))
            .dropDuplicates()
        )
        found = written(_with_sets(pairs, sets).mapInPandas(_verify(percent), "a long, b long"))
        roots = _roots(found, roots)
        used = centres.select("key", F.col("centre_node").alias("node"))
        members = open_members.drop("root").join(used, ["key", "node"], "left_anti")


def near_duplicates(
    docs: DataFrame,
    *,
    words: int = 5,
    bands: int = BANDS,
    rows: int = ROWS,
    percent: int = PERCENT,
    slots: int = SLOTS,
) -> DataFrame:
    """One row per row of ``docs`` (doc_id bigint, text): doc_id, n_shingles, component_id, kept.

    ``component_id`` is the smallest doc_id reachable over links, ``kept`` says whether it is the
    row's own. Null, empty and blank texts have no shingles and are linked with nothing. Rows
    without an id are linked with nothing either: their component is null and they are kept.
    Repeated rows get equal results. Further columns are left out, whatever their names; an empty
    table gives an empty result.
    """
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), whole("text").alias("text"))
    sketched = written(texts.mapInPandas(_sketches(words, bands, rows), SETS))
    classes = written(
        sketched.where("doc_id IS NOT NULL AND n_shingles > 0").groupBy("set_key")
        .agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"))
    )
    roots = _linked(docs, classes, words, bands, rows, percent, slots)
    named = classes.select("set_key", "node")
    if roots is not None:
        named = named.join(roots, "node", "left")
    else:
        named = named.withColumn("root", F.lit(None).cast("bigint"))
    named = named.select(F.col("set_key").alias("key"), F.coalesce("root", "node").alias("component_id"))
    linked = sketched.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("set_key")).alias("set_key"))
    joined = linked.join(named, F.col("set_key") == F.col("key"), "left")
    component = F.coalesce("component_id", "doc_id")
    return joined.select(
        "doc_id", "n_shingles", component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )


SQL = r"""
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
),
sets AS (
    SELECT doc_id, CASE WHEN len(w) < 2 THEN w ELSE list_distinct(list_transform(range(1, len(w)),
        lambda i: w[i] || ' ' || w[i + 1])) END AS s FROM words
),
shingles AS (SELECT doc_id, unnest(s) AS s FROM sets),
rare AS (
    -- In order of frequency, two sets at the threshold share one of the first fifth, and one more.
    SELECT doc_id, s, size FROM (
        SELECT doc_id, s, count(*) OVER (PARTITION BY doc_id) AS size,
            row_number() OVER (PARTITION BY doc_id ORDER BY n, s) AS place
        FROM (SELECT doc_id, s, count(*) OVER (PARTITION BY s) AS n FROM shingles))
    WHERE place <= size - ceil(0.8 * size) + 1
),
candidates AS (
    SELECT DISTINCT a.doc_id AS a, b.doc_id AS b FROM rare a JOIN rare b ON a.s = b.s AND a.doc_id < b.doc_id
    WHERE 100 * least(a.size, b.size) >= 80 * greatest(a.size, b.size)
),
links AS (
    SELECT a, b FROM candidates JOIN sets x ON a = x.doc_id JOIN sets y ON b = y.doc_id
    WHERE 100 * len(list_intersect(x.s, y.s)) >= 80 * (len(x.s) + len(y.s) - len(list_intersect(x.s, y.s)))
),
edges AS (SELECT a AS u, b AS v FROM links UNION SELECT b, a FROM links),
reach AS (
    SELECT doc_id AS u, doc_id AS v FROM documents
    UNION
    SELECT r.u, e.v FROM reach r JOIN edges e ON r.v = e.u
)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, min(v) AS component_id, s.doc_id = min(v) AS kept
FROM sets s JOIN reach ON s.doc_id = u GROUP BY s.doc_id, s.s
"""
