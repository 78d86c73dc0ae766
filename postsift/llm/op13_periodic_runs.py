"""Periodic runs of words: maximal stretches that repeat their first q words at least twice.

A run of period q is a stretch whose words equal those q further on, at least q times in a row.
Short periods are found by comparing a text with itself at every lag. For longer ones, scale m
covers the periods from m to 2m - 1: every window of m / 2 blocks of m / 2 words has a minimizer,
the leftmost block with the least hash. Inside a run the same window comes back q words later, and
its minimizer with it, so blocks that hold equal minimizers between m and 2m - 1 words apart are
seeds, which are extended word by word.

A block that repeats within half its length lies in a stretch of a shorter period and would come up
at every turn of it. Its places are joined to chains: two places of one chain only show the shorter
period, and of two chains every lag shows at the end of one of them. So seeds stay in proportion to
the words of a text, even if it is one word over and over.

Blocks of texts are compared at once, texts being kept apart by signs that equal no word. A text is
worked on whole, in memory in proportion to it. Nothing is shuffled.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator, Sequence
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import whole, words_of

MIN_LENGTH = 12  # words of the shortest run
DIRECT = 16  # shorter periods are found by comparing at every lag; a power of two
BLOCK_WORDS = 100_000  # words compared at once; a longer text is a block of its own

RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def _mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of pairs; the numbers are odd constants without meaning."""
    x = (a ^ (b * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x632BE59BD9B4E019))) * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(29))


def _stretches(codes: np.ndarray, lag: int, least: int) -> list[tuple[int, int, int]]:
    """Maximal (start, end, lag) with at least ``least`` words that equal the word ``lag`` later."""
    at = np.flatnonzero(codes[:-lag] == codes[lag:])
    if len(at) < least:
        return []
    breaks = np.flatnonzero(np.diff(at) != 1)
    first, last = at[np.concatenate(([0], breaks + 1))], at[np.concatenate((breaks, [len(at) - 1]))]
    long = last - first + 1 >= least
    return [(s, e + 1 + lag, lag) for s, e in zip(first[long].tolist(), last[long].tolist(), strict=True)]


def _minimizers(hashes: np.ndarray, window: int) -> np.ndarray:
    """Places of the leftmost least hash of each window; ``window`` is a power of two."""
    bits = np.uint64(len(hashes).bit_length())
    least = (hashes >> bits << bits) | np.arange(len(hashes), dtype=np.uint64)
    step = 1
    while step < window:
        least = np.minimum(least[:-step], least[step:])
        step *= 2
    places = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    return places[np.concatenate(([True], places[1:] != places[:-1]))]


def _ranges(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every number of the ranges, and the index of its range."""
    sizes = np.maximum(high - low, 0)
    index = np.repeat(np.arange(len(low)), sizes)
    return index, np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes) + low[index]


def _seeds(hashes: np.ndarray, wanted: np.ndarray, m: int) -> list[tuple[int, int, int]]:
    """(first, end, lag) of blocks of m // 2 words that come again ``lag`` words later, touching ones joined.

    ``hashes`` are those of the blocks of one text, ``wanted`` the ones that may be seeds.
    """
    half = m // 2
    at = np.flatnonzero(np.isin(hashes, wanted))
    order = np.argsort(hashes[at], kind="stable")
    at, values = at[order], hashes[at[order]]
    new_value = np.concatenate(([True], values[1:] != values[:-1]))
    new_chain = new_value | np.concatenate(([True], np.diff(at) > half // 2))
    chain = np.cumsum(new_chain)
    key = (np.cumsum(new_value) * (len(hashes) + 4 * m)) + at
    ends = np.flatnonzero(np.concatenate((new_chain[1:], [True])))
    # The end of a chain against later places, and against earlier ones of other chains.
    i, j = _ranges(np.searchsorted(key, key[ends] + m), np.searchsorted(key, key[ends] + 2 * m))
    after = np.column_stack((at[j] - at[ends[i]], at[ends[i]]))
    i, j = _ranges(np.searchsorted(key, key[ends] - 2 * m, "right"), np.searchsorted(key, key[ends] - m, "right"))
    apart = chain[j] != chain[ends[i]]
    i, j = i[apart], j[apart]
    pairs = np.unique(np.concatenate((after, np.column_stack((at[ends[i]] - at[j], at[j])))), axis=0)
    if not len(pairs):
        return []
    lag, first = pairs[:, 0], pairs[:, 1]
    new = np.concatenate(([True], (np.diff(lag) != 0) | (np.diff(first) > half)))
    starts = np.flatnonzero(new)
    lasts = np.concatenate((starts[1:] - 1, [len(pairs) - 1]))
    return list(zip(first[starts].tolist(), (first[lasts] + half).tolist(), lag[starts].tolist(), strict=True))


def _equal_after(codes: np.ndarray, at: int, lag: int, chunk: int) -> int:
    """How many words from ``at`` on equal the word ``lag`` later."""
    done, stop = at, len(codes) - lag
    while done < stop:
        end = min(done + chunk, stop)
        differ = codes[done:end] != codes[done + lag : end + lag]
        if differ.any():
            return done + int(differ.argmax()) - at
        done, chunk = end, 2 * chunk
    return done - at


def _equal_before(codes: np.ndarray, at: int, lag: int, chunk: int) -> int:
    """How many words right before ``at`` equal the word ``lag`` later."""
    done = at
    while done > 0:
        start = max(done - chunk, 0)
        differ = codes[start:done] != codes[start + lag : done + lag]
        if differ.any():
            return at - (start + len(differ) - int(differ[::-1].argmax()))
        done, chunk = start, 2 * chunk
    return at


def _extended(codes: np.ndarray, first: int, end: int, lag: int, chunk: int) -> tuple[int, int, int] | None:
    """The run around a seed, if its words do repeat often enough."""
    if not np.array_equal(codes[first:end], codes[first + lag : end + lag]):
        return None  # equal hashes of different blocks
    end += _equal_after(codes, end, lag, chunk)
    first -= _equal_before(codes, first, lag, chunk)
    return (first, end + lag, lag) if end - first >= lag else None


def find_runs(codes: np.ndarray, sizes: Sequence[int], min_length: int = MIN_LENGTH) -> list[tuple[int, int, int]]:
    """Every run (start, end, smallest period) of texts that follow one another in ``codes``.

    ``sizes`` are the numbers of words of the texts, in descending order; each text is followed by
    a sign that occurs once.
    """
    found = []
    for lag in range(1, min(DIRECT, len(codes))):
        found += _stretches(codes, lag, max(min_length - lag, lag))
    starts = np.concatenate(([0], np.cumsum(np.asarray(sizes, np.int64) + 1)))
    hashes, length, m = _mixed(codes.astype(np.uint64), codes.astype(np.uint64)), 1, DIRECT
    while len(sizes) and sizes[0] >= 2 * m:
        half = m // 2
        # Only texts that can hold two periods; the longest ones come first.
        texts = int(np.searchsorted(-np.asarray(sizes), -2 * m, "right"))
        hashes = hashes[: starts[texts] - length + 1]
        while length < half:
            hashes, length = _mixed(hashes[:-length], hashes[length:]), 2 * length
        places = _minimizers(hashes, half)
        order = np.argsort(hashes[places], kind="stable")
        places = places[order]
        values = hashes[places]
        again = np.flatnonzero((values[1:] == values[:-1]) & (np.diff(places) < 2 * m))
        texts_of = np.searchsorted(starts, places[again], "right") - 1
        for text in np.unique(texts_of).tolist():
            s, e = int(starts[text]), int(starts[text + 1]) - 1
            own = codes[s:e]
            seeds = _seeds(hashes[s : e - half + 1], np.unique(values[again[texts_of == text]]), m)
            runs = (_extended(own, *seed, half) for seed in seeds)
            found += [(s + a, s + b, lag) for a, b, lag in filter(None, runs) if b - a >= min_length]
        m *= 2
    # A stretch also repeats at every multiple of its smallest period.
    least: dict[tuple[int, int], int] = {}
    for start, end, lag in found:
        least[start, end] = min(lag, least.get((start, end), lag))
    return sorted((start, end, lag) for (start, end), lag in least.items())


def runs_of(texts: list[list[bytes]], min_length: int = MIN_LENGTH) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of every run of each text, by start, then period."""
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    numbers: defaultdict = defaultdict(count().__next__)
    codes = [
        np.fromiter(map(numbers.__getitem__, [*texts[i], ("end", i)]), np.int64, len(texts[i]) + 1) for i in order
    ]
    sizes = [len(texts[i]) for i in order]
    starts = np.concatenate(([0], np.cumsum(np.asarray(sizes, np.int64) + 1)))
    found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for start, end, period in find_runs(np.concatenate(codes), sizes, min_length) if texts else []:
        place = int(np.searchsorted(starts, start, "right")) - 1
        found[order[place]].append((start - int(starts[place]), end - start, period))
    return [sorted(runs, key=lambda run: (run[0], run[2])) for runs in found]


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that some run holds after its first period."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]


def _blocks(texts: Iterable[pa.Scalar]) -> Iterator[list[list[bytes]]]:
    block, size = [], 0
    for text in texts:
        block.append(text.as_py().split())  # of bytes: blank, tab, newline, and the three signs after it
        size += len(block[-1]) + 1
        if size >= BLOCK_WORDS:
            yield block
            block, size = [], 0
    if block:
        yield block


def _answer(block: list[list[bytes]], min_length: int) -> list[pa.Array]:
    found = runs_of(block, min_length)
    numbers = np.array([number for own in found for run in own for number in run], np.int64).reshape(-1, 3)
    runs = pa.StructArray.from_arrays(list(map(pa.array, numbers.T.copy())), ["start", "length", "period"])
    offsets = np.cumsum([0, *map(len, found)])
    left = (b" ".join(collapsed(words, own)) for words, own in zip(block, found, strict=True))
    return [
        pa.array(list(map(len, block)), pa.int64()),
        pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), runs),
        pa.array(left, pa.binary(), size=len(block)),
    ]


def periodic_runs(
    docs: DataFrame, *, text: str | Column = "text", keep: Sequence[str] = (), min_length: int = MIN_LENGTH
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, runs, collapsed.

    ``runs`` are all maximal stretches of at least ``min_length`` words and two periods, with their
    smallest period, by start, then period. ``collapsed`` are the words that are in no run, or among
    the first period of all runs they are in, joined by single blanks. Null and empty texts, and
    those of blanks, have no words and no runs. Repeated rows and null ids are kept, further columns
    left out unless ``keep`` names them. An empty table gives an empty result.
    """
    chosen = docs.select("doc_id", *keep, whole(text).cast("binary").alias("words_in"))
    schema = T.StructType([
        *chosen.schema.fields[:-1],
        T.StructField("n_words", T.LongType()),
        T.StructField("runs", T.ArrayType(T.StructType([
            T.StructField(name, T.LongType()) for name in ("start", "length", "period")
        ]))),
        T.StructField("collapsed_bytes", T.BinaryType()),
    ])
    names = schema.names

    def answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for block in _blocks(batch.column(batch.num_columns - 1)):
                same = batch.slice(done, len(block)).columns[:-1]
                yield pa.RecordBatch.from_arrays([*same, *_answer(block, min_length)], names)
                done += len(block)

    done = chosen.mapInArrow(answered, schema)
    return done.select("doc_id", *keep, "n_words", "runs", F.col("collapsed_bytes").cast("string").alias("collapsed"))


def looped(text: Column, number: Column) -> Column:
    """A text made periodic where a number is a multiple of ten, else as it is.

    With g, a tenth of the number: the words from g % n on repeat the first
    1 + (n - a) // (3 + g % 8) of them.
    """
    words = words_of(text)
    n, g = F.size(words), F.floor(number / 10)
    a = (g % F.greatest(n, F.lit(1))).cast("int")
    p = (F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))).cast("int")
    turns = F.flatten(F.array_repeat(F.slice(words, a + 1, p), F.ceil((n - a) / p).cast("int")))
    whole_text = F.array_join(F.concat(F.slice(words, F.lit(1), a), F.slice(turns, F.lit(1), n - a)), " ")
    return F.when((number % 10 == 0) & (n > 0), whole_text).otherwise(text)


def digests(found: DataFrame) -> DataFrame:
    """Adds number, longest run (ties: smallest start, then period) and digests to ``periodic_runs``."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(
        r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period")
    )))
    lines = F.transform("runs", lambda r: F.concat_ws(
        ",", r["start"].cast("string"), r["length"].cast("string"), F.concat(r["period"].cast("string"), F.lit("\n"))
    ))
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"),
        (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"),
        F.floor(F.lit(1000) * F.col("best.length") / -F.col("best.period")).cast("bigint").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
