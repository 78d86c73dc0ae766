"""Topics: vocabulary, bags of words, topic model, dominant topic, posts per topic.

The model is latent Dirichlet allocation, fitted by expectation maximization of its posterior mode
over all texts: every pass reads every bag of words once, so nothing is left out or drawn twice, and
what a pass does with a text does not depend on how many there are. Only sums per word and topic
leave a task. They, the model and what is sent to the executors are bounded by the vocabulary.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from postsift.defaults import (
    CHUNK,
    FOLD_STEPS,
    MAX_DOC_SHARE,
    MAX_VOCABULARY,
    MIN_DOCS,
    PASSES,
    TOPIC_WORDS,
    TOPICS,
)
from postsift.functions.text import clean_tokens, word_counts
from postsift.storage import written

_log = logging.getLogger(__name__)


def sample_rows(df: DataFrame, size: int, id: str = "id") -> DataFrame:
    """``size`` rows without replacement, the same ones on every run.

    The rows with the smallest md5 of their id as text. Nearly all of the others are filtered
    out in the scan by a threshold that leaves a little over ``size`` rows to sort.
    """
    rows = df.count()
    if rows <= size:
        return df
    ranked = df.withColumn("__order", F.md5(F.col(id).cast("string").cast("binary")))
    share = (size + 6 * sqrt(size) + 36) / rows
    near = ranked.where(F.col("__order") < f"{int(min(share, 1.0) * (16**12 - 1)):012x}")
    # The threshold leaves too few rows about once in a thousand million times.
    if share < 1.0 and near.limit(size).count() == size:
        ranked = near
    return ranked.orderBy("__order", id).limit(size).drop("__order")


def tokenized(
    df: DataFrame, text: str = "content", stop: Sequence[str] | None = None
) -> DataFrame:
    """Add ``tokens``; a missing text has none."""
    return df.withColumn("tokens", clean_tokens(F.coalesce(F.col(text), F.lit("")), stop))


def vocabulary(
    docs: DataFrame,
    tokens: str = "tokens",
    min_docs: int = MIN_DOCS,
    max_share: float = MAX_DOC_SHARE,
) -> DataFrame:
    """``term, docs``: words found in at least ``min_docs`` and at most a share of the texts.

    Words are made distinct inside their row, so one aggregate counts the texts.
    """
    total = docs.agg(F.count("*").alias("n")).scalar()
    counts = (
        docs.select(F.explode(F.array_distinct(tokens)).alias("term"))
        .groupBy("term")
        .agg(F.count("*").alias("docs"))
    )
    return counts.where((F.col("docs") >= min_docs) & (F.col("docs") <= total * F.lit(max_share)))


def bag_of_words(docs: DataFrame, id: str = "id", tokens: str = "tokens") -> DataFrame:
    """``id, term, count``, one row per text and different word; nothing is shuffled."""
    return docs.select(id, F.inline(word_counts(F.col(tokens))))


#: Bags are worked on in blocks of about so many (text, word) entries.
BLOCK_ENTRIES = 200_000

#: Texts are adjusted together in batches of about so many.
BATCH_ENTRIES = 10_000

#: Words of a topic are ranked by their weight to so many decimals, then by name.
WEIGHT_DECIMALS = 9


@dataclass(frozen=True)
class TopicModel:
    """Topics over known words.

    ``weights[t, w]`` is the share of word w in topic t, ``mass[t]`` the number of words of the
    training texts that went to topic t. A text's share of a topic is smoothed by ``smoothing``
    words; ``steps`` is how often its shares are adjusted, from equal ones on.
    """

    words: tuple[str, ...]
    weights: np.ndarray
    mass: np.ndarray
    smoothing: float
    steps: int = FOLD_STEPS


def first_weights(k: int, size: int, seed: int) -> np.ndarray:
    """Weights to start from: whole-number noise by word and topic, the same everywhere."""
    word, topic = np.arange(1, size + 1, dtype=np.int64), np.arange(1, k + 1, dtype=np.int64)
    noise = (word[None, :] * (2 * topic[:, None] + 1) * 7919 + topic[:, None] * seed * 104729) % 65521
    raw = 0.5 + (noise * noise % 65521) / 65521
    return raw / raw.sum(axis=1, keepdims=True)


@dataclass(frozen=True)
class _Bags:
    """Words and counts of several texts; ``starts`` is where each text's entries begin."""

    words: np.ndarray
    counts: np.ndarray
    starts: np.ndarray

    def blocks(self, texts: int) -> Iterator[_Bags]:
        """In parts of at most ``texts`` texts and about ``BLOCK_ENTRIES`` entries."""
        ends = np.append(self.starts[1:], len(self.words))
        low = 0
        while low < len(self.starts):
            fit = int(np.searchsorted(ends, self.starts[low] + BLOCK_ENTRIES, "right"))
            high = min(max(fit, low + 1), low + texts)
            part = slice(self.starts[low], ends[high - 1])
            yield _Bags(self.words[part], self.counts[part], self.starts[low:high] - self.starts[low])
            low = high


def _bags_of(tokens: pa.Array, words: pa.Array) -> tuple[_Bags, np.ndarray]:
    """Bags of the texts with a known word, and which texts these are."""
    sizes = pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False)
    text_of = np.repeat(np.arange(len(tokens), dtype=np.int64), sizes)
    found = pc.fill_null(pc.index_in(tokens.flatten(), value_set=words), -1)
    number = found.to_numpy(zero_copy_only=False).astype(np.int64)
    key = text_of[number >= 0] * max(len(words), 1) + number[number >= 0]
    key, counts = np.unique(key, return_counts=True)
    texts, starts = np.unique(key // max(len(words), 1), return_index=True)
    return _Bags(key % max(len(words), 1), counts, starts), texts


def _adjusted(bags: _Bags, by_word: np.ndarray, smoothing: float, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Topic sizes of each text, and how each entry's words are dealt to the topics.

    ``by_word`` are the weights, one row per word. Texts of about the same length are adjusted
    together, as matrices that stay in the processor's cache over all steps; what a step deals is
    only listed for the last one.
    """
    lengths = np.diff(np.append(bags.starts, len(bags.words)))
    order = np.argsort(lengths, kind="stable")
    sizes = np.ones((len(lengths), by_word.shape[1]))
    dealt = np.empty((len(bags.words), by_word.shape[1]))
    low = 0
    while low < len(order):
        most = order[low : low + max(1, BATCH_ENTRIES // lengths[order[low]])]
        texts = most[: max(1, BATCH_ENTRIES // lengths[most[-1]])]
        low += len(texts)
        place = np.arange(lengths[texts[-1]])
        inside = place < lengths[texts][:, None]
        entry = np.where(inside, bags.starts[texts][:, None] + place, 0)
        likely = by_word[bags.words[entry]]
        likely[~inside] = 1
        counts = np.where(inside, bags.counts[entry], 0)
        now = before = np.ones((len(texts), by_word.shape[1]))
        ratio = np.ones(entry.shape)
        for _ in range(steps):
            before = now
            ratio = counts / np.matmul(likely, before[:, :, None])[:, :, 0]
            now = smoothing + before * np.matmul(ratio[:, None, :], likely)[:, 0, :]
        likely *= ratio[:, :, None]
        likely *= before[:, None, :]
        sizes[texts] = now
        dealt[entry[inside]] = likely[inside]
    return sizes, dealt


def _encoded(docs: DataFrame, words: Sequence[str]) -> DataFrame:
    """The bags of ``tokens`` by word number, of texts with a known word; written once."""
    listed = docs.sparkSession.sparkContext.broadcast(list(words))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(listed.value, pa.string())
        for batch in batches:
            bags, _ = _bags_of(batch.column(0), known)
            offsets = pa.array(np.append(bags.starts, len(bags.words)), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.ListArray.from_arrays(offsets, pa.array(bags.words, pa.int32())),
                    pa.ListArray.from_arrays(offsets, pa.array(bags.counts, pa.int32())),
                ],
                ["words", "counts"],
            )

    return written(docs.select("tokens").mapInArrow(encode, "words array<int>, counts array<int>"))


def _dealt_words(bags: DataFrame, weights: np.ndarray, smoothing: float, steps: int, chunk: int) -> np.ndarray:
    """Words of all texts by word and topic: summed in the tasks, then over them."""
    k, size = weights.shape
    shared = bags.sparkSession.sparkContext.broadcast(weights)
    names = [f"t{topic}" for topic in range(k)]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, size))
        by_word = np.ascontiguousarray(shared.value.T)
        for batch in batches:
            lists = batch.column(0)
            starts = np.append(0, np.cumsum(pc.list_value_length(lists).to_numpy()))[:-1]
            whole = _Bags(lists.flatten().to_numpy(), batch.column(1).flatten().to_numpy(), starts)
            for block in whole.blocks(chunk):
                _, dealt = _adjusted(block, by_word, smoothing, steps)
                for topic in range(k):
                    total[topic] += np.bincount(block.words, dealt[:, topic], size)
        seen = np.flatnonzero(total.any(axis=0))
        yield pa.RecordBatch.from_arrays(
            [pa.array(seen, pa.int32()), *[pa.array(total[topic][seen]) for topic in range(k)]], ["word", *names]
        )

    schema = "word int, " + ", ".join(f"{name} double" for name in names)
    sums = bags.mapInArrow(deal, schema).groupBy("word").agg(*[F.sum(name).alias(name) for name in names])
    # As many rows as the vocabulary has words.
    rows = sums.toArrow()
    shared.unpersist()
    total = np.zeros((k, size))
    for topic, name in enumerate(names):
        total[topic][rows["word"].to_numpy()] = rows[name].to_numpy()
    return total


def fit_topics(
    df: DataFrame,
    text: str = "content",
    id: str = "id",
    k: int = TOPICS,
    chunk: int = CHUNK,
    passes: float = PASSES,
    sample: int | None = None,
    min_docs: int = MIN_DOCS,
    max_share: float = MAX_DOC_SHARE,
    max_vocabulary: int = MAX_VOCABULARY,
    stop: Sequence[str] | None = None,
    seed: int = 11,
    smoothing: float | None = None,
    steps: int = FOLD_STEPS,
) -> TopicModel:
    """Vocabulary and topics from all texts.

    The vocabulary comes from all texts, or from a sample of ``sample`` of them. At most
    ``max_vocabulary`` words are kept, the most frequent ones; how many were cut is logged.

    Each of the ``passes`` (rounded up) reads the bags of all texts once: a text's words are dealt
    to topics in ``steps`` adjustments, and the weights become the dealt words of all texts, plus
    ``smoothing`` (one k-th by default) for every word. A task works on at most ``chunk`` texts at
    once. A text without a known word says nothing about topics.
    """
    docs = tokenized(df, text, stop)
    known = docs if sample is None else sample_rows(docs.select(id, "tokens"), sample, id)
    # Counted and ranked below.
    terms = written(vocabulary(known, "tokens", min_docs, max_share))
    # The model holds its words anyway. In a fixed order two fits start alike.
    kept = terms.orderBy(F.desc("docs"), F.asc("term")).limit(max_vocabulary).collect()
    if len(kept) == max_vocabulary:
        _log.warning("vocabulary cut to %d words of %d", max_vocabulary, terms.count())
    if not kept:
        raise ValueError("no word is found in enough texts and in few enough")
    words = tuple(row["term"] for row in kept)
    smoothing = 1 / k if smoothing is None else smoothing
    bags = _encoded(docs, words)
    weights, mass = first_weights(k, len(words), seed), np.zeros(k)
    for _ in range(max(1, ceil(passes))):
        dealt = _dealt_words(bags, weights, smoothing, steps, chunk)
        mass = dealt.sum(axis=1)
        weights = (dealt + smoothing) / (mass + len(words) * smoothing)[:, None]
    return TopicModel(words, weights, mass, smoothing, steps)


def topic_weights(spark: SparkSession, model: TopicModel) -> DataFrame:
    """``place, term, weights``: one row per known word with its weight in every topic."""
    table = pa.table({
        "place": pa.array(range(len(model.words)), pa.int32()),
        "term": pa.array(model.words, pa.string()),
        "weights": pa.array(list(model.weights.T), pa.list_(pa.float64())),
    })
    return spark.createDataFrame(table)


def save_topics(model: TopicModel, path: str) -> None:
    """Two tables below ``path``: the weights of every word, and one row about the model."""
    spark = SparkSession.active()
    topic_weights(spark, model).write.mode("overwrite").parquet(f"{path}/weights")
    about = [(model.mass.tolist(), float(model.smoothing), model.steps)]
    schema = "mass array<double>, smoothing double, steps int"
    spark.createDataFrame(about, schema).write.mode("overwrite").parquet(f"{path}/model")


def load_topics(path: str) -> TopicModel:
    spark = SparkSession.active()
    rows = spark.read.parquet(f"{path}/weights").orderBy("place").toArrow()
    about = spark.read.parquet(f"{path}/model").first()
    weights = np.array(rows["weights"].combine_chunks().flatten()).reshape(len(rows), -1).T
    return TopicModel(
        tuple(rows["term"].to_pylist()), weights, np.array(about["mass"]), about["smoothing"], about["steps"]
    )


def assign_topics(
    df: DataFrame,
    model: TopicModel,
    text: str = "content",
    drop_empty: bool = True,
    stop: Sequence[str] | None = None,
) -> DataFrame:
    """Add ``topic_id``, the largest topic of each text; of equal ones the first.

    A text without known words is dropped, or gets the topic that took most words in training.
    """
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("int")
    def dominant(tokens: pa.Array) -> pa.Array:
        fitted = shared.value
        bags, texts = _bags_of(tokens, pa.array(fitted.words, pa.string()))
        best = np.full(len(tokens), -1, np.int32)
        by_word = np.ascontiguousarray(fitted.weights.T)
        at = 0
        for block in bags.blocks(CHUNK):
            sizes, _ = _adjusted(block, by_word, fitted.smoothing, fitted.steps)
            best[texts[at : at + len(sizes)]] = sizes.argmax(axis=1)
            at += len(sizes)
        return pa.array(best, mask=best < 0)

    columns = [F.col(name) for name in df.columns]
    topic = dominant(clean_tokens(F.coalesce(F.col(text), F.lit("")), stop))
    scored = df.select(*columns, topic.alias("__topic"))
    if not drop_empty:
        filled = F.coalesce("__topic", F.lit(int(model.mass.argmax())))
        return scored.select(*columns, filled.alias("topic_id"))
    # Not a filter: that would be moved below this and infer every topic a second time.
    kept = F.explode(F.array_compact(F.array("__topic")))
    return scored.select(*columns, kept.alias("topic_id"))


def _labels(model: TopicModel, words: int) -> list[str]:
    def best(weights: np.ndarray) -> list[str]:
        ranked = sorted(zip((-weights).round(WEIGHT_DECIMALS).tolist(), model.words, strict=True))
        return [word for _, word in ranked[:words]]

    return [" ".join(best(weights)) for weights in model.weights]


def topic_labels(df: DataFrame, model: TopicModel, words: int = TOPIC_WORDS) -> DataFrame:
    """``topic_id, topic_words``: the top words of each topic, in the session of ``df``."""
    rows = list(enumerate(_labels(model, words)))
    return df.sparkSession.createDataFrame(rows, "topic_id int, topic_words string")


def topic_counts(
    df: DataFrame,
    model: TopicModel,
    text: str = "content",
    drop_empty: bool = True,
    words: int = TOPIC_WORDS,
    stop: Sequence[str] | None = None,
) -> DataFrame:
    """``topic_words, count``: texts per topic label, most first.

    Counted by topic id first; the k labels are looked up afterwards.
    """
    assigned = assign_topics(df.select(text), model, text, drop_empty, stop)
    counts = assigned.groupBy("topic_id").agg(F.count("*").alias("n"))
    labels = F.array(*[F.lit(label) for label in _labels(model, words)])
    named = counts.withColumn("topic_words", F.get(labels, F.col("topic_id")))
    return (
        named.groupBy("topic_words")
        .agg(F.sum("n").alias("count"))
        .orderBy(F.desc("count"), F.asc("topic_words"))
    )
