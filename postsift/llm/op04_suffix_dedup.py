"""Substring dedup of byte strings of a fixed length, by buckets of suffixes and a cover sample.

Only ties of ``length`` bytes matter, so suffixes are put in buckets, and compared, by hashes of
their beginnings. What sorting all suffixes would cost is saved by a cover sample: a set of places
such that two equal strings hold a sampled place at the same offset. A difference cover has that
property for any alignment; here the sample is chosen by content (in every string the place with the
least hash of the ``gram`` bytes there), which has it too and is about four times smaller.

1. Documents are packed into chunks, written once. Places are ordered by doc_id, then start.
2. Every sampled place gets a rank from its gram, which names its bucket, and a hash of all strings
   that it stands for. One bucket is sorted at a time. Places alone in their gram are done: their
   strings occur once. Long ties are resolved by the ranks: a place whose strings all lie in an
   earlier, equal surrounding is repeated as a whole. What is left is the first place of every
   surrounding whose gram has others, which are the edges of repeats.
3. Strings of these places are put into buckets and sorted one by one.
4. Chunks meet the answers, repeated strings are joined to runs of bytes, and what is left is hashed.

Rows of the shuffles are packed arrays, one per chunk and bucket, with every string of a chunk sent
once: a string that a third of all documents hold comes once per chunk. A bucket's size is bounded
by choosing their number from the size of the input. A text longer than a chunk is cut into parts
that overlap by a string.

Equality is that of two independent 64-bit hashes in step 2, of one in step 3.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postsift.storage import written

from .common import whole

LENGTH = 100
CHUNK_BYTES = 2 << 20
# Input bytes per bucket; a bucket holds some 17 bytes for every 30 of these.
BUCKET_BYTES = 32 << 20
# Chunks per partition where chunks meet answers.
CHUNKS_PER_TASK = 8

CHUNKS = "chunk bigint, n_bytes bigint, first boolean, last boolean, doc_ids array<bigint>, sizes array<bigint>, data binary"
SENT = "chunk bigint, bucket bigint, blob binary"
PARTS = (
    "doc_id bigint, owner bigint, part bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, "
    "data binary, runs binary"
)
_NO_ID = np.iinfo(np.int64).max
_R = 0x9E3779B97F4A7C15 | 5
_PLACE_BITS = np.uint64(24)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTES = _mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))


@lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2 ** 64."""
    up = np.full(n, _R, np.uint64)
    down = np.full(n, pow(_R, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=np.uint64), np.cumprod(down, dtype=np.uint64)


class Hashes:
    """Hashes of any stretch of some bytes, from running sums."""

    def __init__(self, data: np.ndarray):
        n = len(data)
        up, self._down = _powers(1 << max(16, int(n).bit_length()))
        self._sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_BYTES[data] * up[:n], out=self._sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mix((self._sums[end] - self._sums[start]) * self._down[start])

    def all_of(self, size: int) -> np.ndarray:
        n = len(self._sums) - size
        return _mix((self._sums[size:] - self._sums[:n]) * self._down[:n])


def _spread(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """All numbers of ranges that include both ends."""
    sizes = last - first + 1
    if not len(sizes):
        return np.zeros(0, np.int64)
    return np.repeat(first - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())


@dataclass
class Sample:
    """Sampled places of a chunk in order: document, the starts each stands for, two hashes."""

    doc: np.ndarray
    low: np.ndarray
    high: np.ndarray
    gram: np.ndarray
    around: np.ndarray


def _starts(sizes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of all strings that lie in one document, and the document of each."""
    ends = np.cumsum(sizes)
    long = np.flatnonzero(sizes >= length)
    starts = _spread(ends[long] - sizes[long], ends[long] - length)
    return starts, np.repeat(long, sizes[long] - length + 1)


def cover_sample(data: np.ndarray, sizes: np.ndarray, length: int, hashes: Hashes) -> Sample:
    gram = max(1, 2 * length // 5)
    starts, doc = _starts(sizes, length)
    if not len(starts):
        none = np.zeros(0, np.int64)
        return Sample(none, none, none, none.astype(np.uint64), none.astype(np.uint64))
    grams = hashes.all_of(gram)
    least = (grams >> _PLACE_BITS << _PLACE_BITS) | np.arange(len(grams), dtype=np.uint64)
    window, size = length - gram + 1, 1
    while 2 * size <= window:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < window:
        rest = window - size
        least = np.minimum(least[:-rest], least[rest:])
    place = (least[starts] & np.uint64((1 << 24) - 1)).astype(np.int64)
    cut = np.flatnonzero((np.diff(place) != 0) | (np.diff(doc) != 0)) + 1
    first, last = np.concatenate([[0], cut]), np.concatenate([cut, [len(starts)]]) - 1
    low, high, at = starts[first], starts[last], place[first]
    around = hashes.of(low, high + length)
    around = _mix(around ^ _mix(((at - low) * (1 << 20) + (high - low)).astype(np.uint64) + np.uint64(1)))
    return Sample(doc[first], low, high, grams[at], around)


def _distinct(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first row of every distinct key in key order, and for every row whether it is one."""
    n = len(keys[0])
    order = np.lexsort((np.arange(n), *reversed(keys)))
    new = np.ones(n, bool)
    if n:
        new[1:] = np.logical_or.reduce([key[order][1:] != key[order][:-1] for key in keys])
    first = np.zeros(n, bool)
    first[order[new]] = True
    return order[new], first


def _pack(doc: np.ndarray, doc_ids: np.ndarray, *hashes: np.ndarray) -> bytes:
    """Hashes with the document of each: ids once, then numbers of these."""
    held, number = np.unique(doc, return_inverse=True)
    head = np.array([len(doc), len(held)], np.int64)
    return b"".join(x.tobytes() for x in (head, doc_ids[held], number.astype(np.int32), *hashes))


def _unpack(blob: bytes, count: int) -> list[np.ndarray]:
    n, held = np.frombuffer(blob, np.int64, 2)
    ids = np.frombuffer(blob, np.int64, held, 16)
    at = 16 + 8 * held
    number = np.frombuffer(blob, np.int32, n, at)
    at += 4 * n
    return [ids[number], *(np.frombuffer(blob[at + 8 * n * k : at + 8 * n * (k + 1)], np.uint64) for k in range(count))]


def _chunks(chunk_bytes: int, length: int):
    def chunk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        packer = zstandard.ZstdCompressor(level=3)
        number = TaskContext.get().partitionId() << 32
        names = [part.split()[0] for part in CHUNKS.split(", ")]

        def row(docs: list[tuple[int, bytes]], first: bool = True, last: bool = True) -> pd.DataFrame:
            nonlocal number
            number += 1
            data = b"".join(text for _, text in docs)
            sizes = [len(text) for _, text in docs]
            return pd.DataFrame([(number, len(data), first, last, [i for i, _ in docs], sizes, packer.compress(data))], columns=names)

        held, size = [], 0
        for rows in batches:
            for doc_id, text in zip(rows["doc_id"], rows["text"], strict=True):
                doc_id = _NO_ID if pd.isna(doc_id) else int(doc_id)
                data = text.encode("utf-8", "replace")
                if len(data) > 2 * chunk_bytes:
                    for start in range(0, len(data), chunk_bytes):
                        # Every part but the last holds the strings that start in it.
                        part = data[start : start + chunk_bytes + length - 1]
                        yield row([(doc_id, part)], start == 0, start + chunk_bytes >= len(data))
                    continue
                held.append((doc_id, data))
                size += len(data)
                if size >= chunk_bytes:
                    yield row(sorted(held, key=lambda doc: doc[0]))
                    held, size = [], 0
        if held:
            yield row(sorted(held, key=lambda doc: doc[0]))

    return chunk


def _opened(row) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    size = int(row.n_bytes)
    data = zstandard.ZstdDecompressor().decompress(row.data, max_output_size=max(size, 1)) if size else b""
    return np.frombuffer(data, np.uint8), np.asarray(row.sizes, np.int64), np.asarray(row.doc_ids, np.int64)


def _sent(chunk: int, bucket: np.ndarray, pick: np.ndarray, doc: np.ndarray, doc_ids: np.ndarray, *hashes: np.ndarray) -> list:
    """One packed row per bucket of the picked places; their order is that of ``pick``."""
    rows = []
    order = np.argsort(bucket, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1) if len(order) else []:
        at = pick[part]
        rows.append((chunk, int(bucket[part[0]]), _pack(doc[at], doc_ids, *(h[at] for h in hashes))))
    return rows


def _frame(rows: list) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["chunk", "bucket", "blob"])


def _send_sample(length: int, buckets: int):
    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for row in rows.itertuples(index=False):
                data, sizes, doc_ids = _opened(row)
                sample = cover_sample(data, sizes, length, Hashes(data))
                pick, _ = _distinct(sample.gram, sample.around)
                bucket = (sample.gram[pick] % np.uint64(buckets)).astype(np.int64)
                yield _frame(_sent(row.chunk, bucket, pick, sample.doc, doc_ids, sample.gram, sample.around))

    return send


def _in_order(rows: pd.DataFrame, count: int) -> tuple[pd.DataFrame, np.ndarray, list[np.ndarray]]:
    """A bucket's rows in order of chunks, its places' rank in the order of the corpus, the hashes."""
    rows = rows.sort_values("chunk", kind="stable")
    parts = [_unpack(blob, count) for blob in rows["blob"]]
    ids = np.concatenate([part[0] for part in parts])
    return rows, ids, [np.concatenate([part[k + 1] for part in parts]) for k in range(count)]


def _answers(rows: pd.DataFrame, codes: np.ndarray) -> pd.DataFrame:
    sizes = [int(np.frombuffer(blob, np.int64, 1)[0]) for blob in rows["blob"]]
    parts = np.split(codes.astype(np.uint8), np.cumsum(sizes)[:-1])
    return _frame([(c, b, p.tobytes()) for c, b, p in zip(rows["chunk"], rows["bucket"], parts, strict=True)])


def _sort_sample_bucket(rows: pd.DataFrame) -> pd.DataFrame:
    """Per place 0: nothing repeats, 1: repeated as a whole, 2: strings have to be compared."""
    rows, ids, (gram, around) = _in_order(rows, 2)
    order = np.lexsort((np.arange(len(ids)), ids, around, gram))
    new_gram = np.concatenate([[True], np.diff(gram[order]) != 0])
    new_around = new_gram | np.concatenate([[True], np.diff(around[order]) != 0])
    group = np.cumsum(new_gram) - 1
    others = np.bincount(group, new_around) > 1
    codes = np.zeros(len(ids), np.uint8)
    codes[order] = np.where(new_around, np.where(others[group], 2, 0), 1)
    return _answers(rows, codes)


def _sort_string_bucket(rows: pd.DataFrame) -> pd.DataFrame:
    """Per string 1 if an equal one is earlier, else 0."""
    rows, ids, (string,) = _in_order(rows, 1)
    order = np.lexsort((np.arange(len(ids)), ids, string))
    codes = np.zeros(len(ids), np.uint8)
    codes[order] = np.concatenate([[False], np.diff(string[order]) == 0])
    return _answers(rows, codes)


def _read_answers(answers, bucket: np.ndarray) -> np.ndarray:
    """Codes in the order in which the places were picked."""
    codes = np.zeros(len(bucket), np.uint8)
    order = np.argsort(bucket, kind="stable")
    parts = np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1) if len(order) else []
    found = {int(a["bucket"]): a["blob"] for a in answers}
    for part in parts:
        codes[part] = np.frombuffer(found[int(bucket[part[0]])], np.uint8)
    return codes


def _send_strings(length: int, buckets: int):
    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for row in rows.itertuples(index=False):
                data, sizes, doc_ids = _opened(row)
                hashes = Hashes(data)
                sample = cover_sample(data, sizes, length, hashes)
                pick, first = _distinct(sample.gram, sample.around)
                bucket = (sample.gram[pick] % np.uint64(buckets)).astype(np.int64)
                codes = np.ones(len(first), np.uint8)
                codes[pick] = _read_answers(row.answers, bucket)
                whole_at, open_at = np.flatnonzero(codes == 1), np.flatnonzero(codes == 2)
                state = np.concatenate([
                    np.array([len(whole_at), len(open_at)]), sample.low[whole_at], sample.high[whole_at],
                    sample.low[open_at], sample.high[open_at],
                ]).astype(np.int32)
                starts = _spread(sample.low[open_at], sample.high[open_at])
                doc = np.repeat(sample.doc[open_at], sample.high[open_at] - sample.low[open_at] + 1)
                string = hashes.of(starts, starts + length)
                pick, _ = _distinct(string)
                bucket = (string[pick] % np.uint64(buckets)).astype(np.int64)
                yield _frame([(row.chunk, -1, state.tobytes()), *_sent(row.chunk, bucket, pick, doc, doc_ids, string)])

    return send


def _runs(starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of bytes, from and up to, that strings at sorted starts cover."""
    if not len(starts):
        return starts, starts
    cut = np.flatnonzero(np.diff(starts) > length)
    return starts[np.concatenate([[0], cut + 1])], starts[np.concatenate([cut, [len(starts) - 1]])] + length


def _without(data: bytes, low: np.ndarray, high: np.ndarray) -> bytes:
    edges = [0, *np.stack([low, high], 1).reshape(-1).tolist(), len(data)]
    return b"".join(data[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2))


def _remove(length: int, buckets: int):
    names = [part.split()[0] for part in PARTS.split(", ")]

    def remove(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for row in rows.itertuples(index=False):
                data, sizes, doc_ids = _opened(row)
                state = next(np.frombuffer(a["blob"], np.int32) for a in row.answers if a["bucket"] == -1).astype(np.int64)
                whole_n, open_n = state[:2]
                whole_low, whole_high, open_low, open_high = np.split(
                    state[2:], [whole_n, 2 * whole_n, 2 * whole_n + open_n]
                )
                open_starts = _spread(open_low, open_high)
                string = Hashes(data).of(open_starts, open_starts + length) if len(open_starts) else open_starts.astype(np.uint64)
                pick, first = _distinct(string)
                codes = np.ones(len(first), np.uint8)
                codes[pick] = _read_answers(
                    [a for a in row.answers if a["bucket"] >= 0], (string[pick] % np.uint64(buckets)).astype(np.int64)
                )
                starts = np.sort(np.concatenate([_spread(whole_low, whole_high), open_starts[codes == 1]]))
                ends = np.cumsum(sizes)
                cuts = np.searchsorted(starts, np.concatenate([[0], ends]))
                out = []
                for i, (doc_id, size) in enumerate(zip(doc_ids.tolist(), sizes.tolist(), strict=True)):
                    begin = int(ends[i]) - size
                    low, high = _runs(starts[cuts[i] : cuts[i + 1]] - begin, length)
                    text = data[begin : begin + size].tobytes()
                    shown = None if doc_id == _NO_ID else doc_id
                    if row.first and row.last:
                        kept = hashlib.sha256(_without(text, low, high)).hexdigest()
                        out.append((shown, 0, -1, size, int((high - low).sum()), len(low), kept, None, None))
                    else:
                        runs = np.stack([low, high]).astype(np.int64).tobytes()
                        out.append((shown, 0, row.chunk, size, 0, 0, None, text, runs))
                yield pd.DataFrame(out, columns=names).astype({"doc_id": "Int64"})

    return remove


def _join_parts(chunk_bytes: int):
    def join(rows: pd.DataFrame) -> pd.DataFrame:
        """Puts the parts of a long text together; all but the last end with what the next begins."""
        rows = rows.sort_values("part", kind="stable")
        at, data, lows, highs = 0, [], [], []
        for k, (text, runs) in enumerate(zip(rows["data"], rows["runs"], strict=True)):
            low, high = np.frombuffer(runs, np.int64).reshape(2, -1)
            lows.append(low + at)
            highs.append(high + at)
            own = text if k == len(rows) - 1 else text[:chunk_bytes]
            data.append(own)
            at += len(own)
        text = b"".join(data)
        covered = np.zeros(len(text) + 1, np.int32)
        np.add.at(covered, np.concatenate(lows), 1)
        np.add.at(covered, np.concatenate(highs), -1)
        edge = np.diff(np.concatenate([[0], (np.cumsum(covered[:-1]) > 0).astype(np.int8), [0]]))
        low, high = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        kept = hashlib.sha256(_without(text, low, high)).hexdigest()
        doc_id = rows["doc_id"].iloc[0]
        return pd.DataFrame(
            [(doc_id, len(text), int((high - low).sum()), len(low), kept)],
            columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
        ).astype({"doc_id": "Int64"})

    return join


def remove_repeated_bytes(
    docs: DataFrame, *, length: int = LENGTH, chunk_bytes: int = CHUNK_BYTES, bucket_bytes: int = BUCKET_BYTES
) -> DataFrame:
    """One row per row of ``docs`` (doc_id bigint, text): doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    A byte is removed if a string of ``length`` bytes that also starts earlier covers it. Null and
    short texts have no strings. Repeated rows count one after the other, and so do rows without
    an id, which come last. Further columns are left out, whatever their names; an empty table
    gives an empty result.
    """
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), whole("text").alias("text"))
    chunks = written(texts.mapInPandas(_chunks(chunk_bytes, length), CHUNKS))
    size = chunks.agg(F.count("*").alias("n"), F.coalesce(F.sum("n_bytes"), F.lit(0)).alias("bytes")).first()
    buckets = max(12, -(-size["bytes"] // bucket_bytes))
    tasks = max(12, -(-size["n"] // CHUNKS_PER_TASK))

    def sorted_by_bucket(sent: DataFrame, sort) -> DataFrame:
        dealt = sent.repartition(int(buckets), "bucket")
        return dealt.groupBy("bucket").applyInPandas(sort, SENT)

    def with_answers(*answers: DataFrame) -> DataFrame:
        rows = answers[0]
        for more in answers[1:]:
            rows = rows.unionByName(more)
        gathered = rows.repartition(tasks, "chunk").groupBy("chunk").agg(F.collect_list(F.struct("bucket", "blob")).alias("answers"))
        # A chunk has at most one row per bucket.
        return chunks.repartition(tasks, "chunk").join(gathered, "chunk", "left").withColumn(
            "answers", F.coalesce("answers", F.array().cast("array<struct<bucket:bigint,blob:binary>>"))
        )

    sample = written(sorted_by_bucket(chunks.mapInPandas(_send_sample(length, buckets), SENT), _sort_sample_bucket))
    strings = written(with_answers(sample).mapInPandas(_send_strings(length, buckets), SENT))
    repeated = written(sorted_by_bucket(strings.where("bucket >= 0"), _sort_string_bucket))
    done = with_answers(strings.where("bucket = -1"), repeated).mapInPandas(_remove(length, buckets), PARTS)
    return _finish(done, chunks, chunk_bytes)


def _finish(done: DataFrame, chunks: DataFrame, chunk_bytes: int) -> DataFrame:
    """Whole documents as they are, parts of long ones put together."""
    columns = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    cut = chunks.where("NOT first OR NOT last")
    if cut.isEmpty():
        return done.select(*columns)
    # Parts of one text are numbered one after the other within a task of the chunking step.
    owners = cut.select(F.col("chunk").alias("part"), F.when(F.col("first"), F.col("chunk")).alias("start"))
    task = F.shiftright("part", 32)
    starts = owners.where("start IS NOT NULL").select(task.alias("task"), F.col("start"))
    owned = (
        owners.select(task.alias("task"), "part").join(starts, "task").where("start <= part")
        .groupBy("part").agg(F.max("start").alias("begins"))
    )
    done = written(done)
    parts = done.where("part >= 0").join(owned, "part").drop("owner").withColumnRenamed("begins", "owner")
    joined = parts.groupBy("owner").applyInPandas(
        _join_parts(chunk_bytes), "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
    )
    return done.where("part < 0").select(*columns).unionByName(joined)
