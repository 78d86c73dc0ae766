"""Substring dedup over sliding sentence spans.

A text is cut into sentences; every run of ``run`` sentences that follow each other is hashed, runs
are joined over the whole corpus, and every sentence that a repeated run covers, unless that run is
the first of its kind, is removed. First is the smallest doc_id, then the earliest run.

Only hashes are shuffled until the end, where a text meets the places to remove. The first of a run
is a minimum, combined before the shuffle; the join back to a run that very many documents hold is
one that the engine can split.

Runs are told apart by 64-bit hashes: among n runs of a corpus, one of them is taken for another
with a probability of n / 2 ** 64.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postsift.storage import written

from .common import whole

RUN = 2
# A run of fewer words is too common to tell anything.
MIN_WORDS = 8

_PIECE = re.compile(r"[^.!?\n]*[.!?\n]+|[^.!?\n]+")

RUNS = "doc_id bigint, text_key bigint, n_sentences bigint, runs array<bigint>, places array<int>"


def pieces(text: str) -> list[str]:
    """The text cut behind its sentence signs and line ends; joined they are the text."""
    return _PIECE.findall(text)


def sentences(text: str) -> list[bytes]:
    """Sentences in order: pieces with a word, A-Z in lower case, words joined by one blank."""
    words = (piece.encode("utf-8", "replace").lower().split() for piece in pieces(text))
    return [b" ".join(row) for row in words if row]


def _hash_runs(run: int, min_words: int):
    def hash_runs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for docs in batches:
            out = []
            for doc_id, text_key, text in docs[["doc_id", "text_key", "text"]].itertuples(index=False):
                found = sentences(text)
                sizes = [sentence.count(b" ") + 1 for sentence in found]
                places = [i for i in range(len(found) - run + 1) if sum(sizes[i : i + run]) >= min_words]
                hashes = [xxhash.xxh64_intdigest(b"\n".join(found[i : i + run])) for i in places]
                out.append((doc_id, text_key, len(found), np.array(hashes, np.uint64).astype(np.int64), places))
            yield pd.DataFrame(out, columns=["doc_id", "text_key", "n_sentences", "runs", "places"]).astype({"doc_id": "Int64"})

    return hash_runs


def _remove(run: int):
    @F.pandas_udf("struct<text:string,n_removed:bigint>")
    def remove(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, repeated in batches:
            out = []
            for text, places in zip(texts, repeated, strict=True):
                if text is None or places is None:
                    out.append((None, 0))
                    continue
                gone = {place + k for place in places for k in range(run)}
                kept, at = [], 0
                for piece in pieces(text):
                    if not piece.encode("utf-8", "replace").split():
                        kept.append(piece)
                        continue
                    if at not in gone:
                        kept.append(piece)
                    at += 1
                out.append(("".join(kept), len(gone)))
            yield pd.DataFrame(out, columns=["text", "n_removed"]).astype({"text": object, "n_removed": "int64"})

    return remove


def remove_repeated_sentences(docs: DataFrame, *, run: int = RUN, min_words: int = MIN_WORDS) -> DataFrame:
    """One row per row of ``docs`` (doc_id bigint, text): doc_id, n_sentences, n_removed, text.

    Pieces without a word are no sentences and always stay. Null and empty texts have none, null
    becomes empty. Rows that repeat id and text are one document and get equal rows. Rows without
    an id come after all others, in order of a hash of their text. Further columns are left out,
    whatever their names; an empty table gives an empty result.
    """
    texts = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), whole("text").alias("text"),
        F.xxhash64(whole("text")).alias("text_key"),
    )
    thin = written(texts.mapInPandas(_hash_runs(run, min_words), RUNS))
    pairs = thin.select("doc_id", "text_key", F.explode(F.arrays_zip("runs", "places")).alias("x"))
    order = F.struct(
        F.col("doc_id").isNull().alias("last"), "doc_id",
        F.when(F.col("doc_id").isNull(), F.col("text_key")).alias("key"), F.col("x.places").alias("place"),
    )
    runs = pairs.select("doc_id", "text_key", F.col("x.runs").alias("hash"), order.alias("at"))
    firsts = runs.groupBy("hash").agg(F.min("at").alias("first"), F.max("at").alias("other")).where("first < other")
    repeated = (
        runs.join(firsts.select("hash", "first"), "hash").where("at > first")
        .groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_set("at.place")).alias("repeated"))
    )
    same = ["doc_id", "text_key"]
    marked = thin.select(*same, "n_sentences").dropDuplicates(same).alias("m").join(
        repeated.alias("r"),
        F.col("m.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("m.text_key") == F.col("r.text_key")), "left",
    ).select(F.col("m.doc_id").alias("marked_id"), F.col("m.text_key").alias("marked_key"), "n_sentences", "repeated")
    joined = texts.join(
        marked, F.col("doc_id").eqNullSafe(F.col("marked_id")) & (F.col("text_key") == F.col("marked_key"))
    )
    removed = joined.withColumn("out", _remove(run)(F.when(F.col("repeated").isNotNull(), F.col("text")), "repeated"))
    return removed.select(
        "doc_id", "n_sentences", F.coalesce("out.n_removed", F.lit(0)).alias("n_removed"),
        F.when(F.col("repeated").isNotNull(), F.col("out.text")).otherwise(F.col("text")).alias("text"),
    )


SQL = rf"""
WITH cut AS (
    SELECT doc_id, i, p[i] AS piece, regexp_extract_all(translate(p[i], 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
        'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
    FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^.!?\n]*[.!?\n]+|[^.!?\n]+') AS p FROM documents),
        unnest(range(1, len(p) + 1)) AS u(i)
),
sentences AS (
    SELECT doc_id, i, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS place, len(w) AS n,
        array_to_string(w, ' ') AS s
    FROM cut WHERE len(w) > 0
),
runs AS (
    SELECT a.doc_id, a.place, a.s || chr(10) || b.s AS r
    FROM sentences a JOIN sentences b ON a.doc_id = b.doc_id AND b.place = a.place + 1 WHERE a.n + b.n >= {MIN_WORDS}
),
later AS (
    SELECT doc_id, place FROM (
        SELECT *, row_number() OVER (PARTITION BY r ORDER BY doc_id, place) AS k FROM runs) WHERE k > 1
),
gone AS (SELECT doc_id, place FROM later UNION SELECT doc_id, place + 1 FROM later),
counts AS (SELECT doc_id, count(*) AS n_sentences FROM sentences GROUP BY doc_id),
removed AS (SELECT doc_id, count(*) AS n_removed FROM gone GROUP BY doc_id),
kept AS (
    SELECT c.doc_id, string_agg(piece, '' ORDER BY c.i) AS text
    FROM cut c LEFT JOIN sentences s ON c.doc_id = s.doc_id AND c.i = s.i
        LEFT JOIN gone g ON s.doc_id = g.doc_id AND s.place = g.place
    WHERE g.place IS NULL GROUP BY c.doc_id
)
SELECT d.doc_id, coalesce(n_sentences, 0) AS n_sentences, coalesce(n_removed, 0) AS n_removed, coalesce(k.text, '') AS text
FROM documents d LEFT JOIN counts c ON d.doc_id = c.doc_id LEFT JOIN removed r ON d.doc_id = r.doc_id
    LEFT JOIN kept k ON d.doc_id = k.doc_id
"""
