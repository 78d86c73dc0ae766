"""Byte-level BPE encoding and decoding as a reduction over a tree of text halves.

A text is halved until its parts are short; parts are encoded alone and neighbours joined on the
way up. Between a visible sign and a following blank there is always a boundary of the splitting
pattern, whatever stands before or after: no alternative of the pattern holds a blank behind a
visible sign, and none looks back. So a join looks for such a place on either side of the seam, in
windows that double until one is found or the part is used up, and encodes again only what lies
between. Tokens outside are those of the whole text. Decoding concatenates up the same kind of tree.

Ids are kept as a binary column of little-endian unsigned 32-bit numbers. Texts are handled in the
scan; nothing is shuffled. The rank table is read on the driver and sent to the executors: its size
is that of a vocabulary, not of the data.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import regex
import tiktoken
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import parts, whole

# Characters of a part that is encoded at once, and ids of one that is decoded at once.
LEAF = 2048
# First size of a boundary window.
WINDOW = 32

# Blanks and visible signs on whose class every engine for such patterns agrees.
_SAFE = regex.compile(r"(?<=[\p{L}\p{N}\p{P}])[ \n]")


class Codec:
    """Encodes and decodes one text with given ranks and splitting pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, leaf: int = LEAF):
        self._plain = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self._leaf = leaf

    def encode(self, text: str) -> np.ndarray:
        return self._encode(text, 0, len(text))

    def _part(self, text: str) -> np.ndarray:
        return np.array(self._plain.encode_ordinary(text), dtype="<u4")

    def _encode(self, text: str, start: int, end: int) -> np.ndarray:
        if end - start <= self._leaf:
            return self._part(text[start:end])
        middle = (start + end) // 2
        left, right = self._encode(text, start, middle), self._encode(text, middle, end)
        p, q = self._last_boundary(text, start, middle), self._first_boundary(text, middle, end)
        if p == start and q == end:
            return self._part(text[start:end])
        keep = len(left) - len(self._part(text[p:middle]))
        drop = len(self._part(text[middle:q]))
        return np.concatenate([left[:keep], self._part(text[p:q]), right[drop:]])

    @staticmethod
    def _last_boundary(text: str, start: int, end: int) -> int:
        """The last sure boundary in a part, or its start."""
        size = WINDOW
        while True:
            low = max(start, end - size)
            # The sign before a boundary belongs to the part as well.
            at = None
            for at in _SAFE.finditer(text, min(low + 1, end), end):
                pass
            if at is not None:
                return at.start()
            if low == start:
                return start
            size *= 2

    @staticmethod
    def _first_boundary(text: str, start: int, end: int) -> int:
        """The first sure boundary in a part, or its end."""
        size = WINDOW
        while True:
            high = min(end, start + size)
            at = _SAFE.search(text, min(start + 1, high), high)
            if at is not None:
                return at.start()
            if high == end:
                return end
            size *= 2

    def decode(self, ids: np.ndarray) -> bytes:
        if len(ids) <= self._leaf:
            return self._plain.decode_bytes(ids.tolist())
        middle = len(ids) // 2
        return self.decode(ids[:middle]) + self.decode(ids[middle:])


def read_ranks(spark: SparkSession, path: str) -> dict[bytes, int]:
    """Ranks of a file with a base64 token and its rank per line; read once, on the driver."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class BytePairs:
    """Column functions for one vocabulary.

    ``encode`` gives the ids of a text (null like empty: no ids), ``decode`` the bytes of ids
    (null ids give null). Neither depends on other rows or columns.
    """

    def __init__(self, spark: SparkSession, path: str, pattern: str, leaf: int = LEAF):
        ranks = read_ranks(spark, path)
        self._key = hashlib.sha256(repr((sorted(ranks.items()), pattern, leaf)).encode()).hexdigest()
        self._shared = spark.sparkContext.broadcast((ranks, pattern, leaf))

    def encode(self, text: Column) -> Column:
        key, shared = self._key, self._shared

        @F.pandas_udf(T.BinaryType())
        def encoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            codec = _codec(key, shared)
            for texts in (part for batch in batches for part in parts(batch)):
                yield pd.Series([codec.encode(text).tobytes() for text in texts], dtype=object)

        return encoded(whole(text))

    def decode(self, ids: Column) -> Column:
        key, shared = self._key, self._shared

        @F.pandas_udf(T.BinaryType())
        def decoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            codec = _codec(key, shared)
            for rows in batches:
                yield pd.Series(
                    [None if row is None else codec.decode(np.frombuffer(row, "<u4")) for row in rows], dtype=object
                )

        return decoded(ids)

    def round_trip(self, text: Column) -> Column:
        """Ids of a text and the bytes that they decode to, in one pass and one worker."""
        key, shared = self._key, self._shared

        @F.pandas_udf("struct<ids:binary,decoded:binary>")
        def both(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            codec = _codec(key, shared)
            for texts in (part for batch in batches for part in parts(batch)):
                ids = [codec.encode(text) for text in texts]
                yield pd.DataFrame({"ids": [row.tobytes() for row in ids], "decoded": [codec.decode(row) for row in ids]}, dtype=object)

        return both(whole(text))


_CODECS: dict[str, Codec] = {}


def _codec(key: str, shared) -> Codec:
    """One codec per vocabulary and worker process."""
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(*shared.value)
    return _CODECS[key]


def encode_decode(docs: DataFrame, pairs: BytePairs, *, text: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_tokens, ids, decoded.

    Null and empty texts have no ids and decode to no bytes. Repeated rows and null ids are kept,
    further columns left out unless ``keep`` names them. An empty table gives an empty result.
    """
    done = docs.select("doc_id", *keep, pairs.round_trip(F.col(text)).alias("bpe"))
    return done.select(
        "doc_id", *keep, (F.octet_length("bpe.ids") / 4).cast("bigint").alias("n_tokens"), "bpe.ids", "bpe.decoded"
    )
