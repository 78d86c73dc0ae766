"""Quality rules: plain counts, and a log-likelihood ratio of hashed word n-grams.

The ratio compares two multinomials over words and neighbouring pairs of words, hashed,: a trusted target (documents
named by id) and the raw corpus (all documents). A document's verdict is its mean ratio per n-gram
against a fixed threshold. Ratios are whole millionths, so sums do not depend on their order.

Everything is DataFrame code. The corpus is read twice, once to count and once to score; only
bucket counts are shuffled, never a text.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small, whole, words_of

BUCKETS = 10_000
UNIT = 1_000_000
# A document is dropped if its mean ratio per n-gram is below this many millionths.
THRESHOLD = -45_000
# Ids of trusted documents are copied to the executors up to this many, joined beyond it.
BROADCAST_IDS = 2_000_000


# Fixed value: how the checksums of two neighbouring words become one number, below 2 ** 49.
PAIR = 65_599


def _checksum(word: Column) -> Column:
    return F.crc32(word.cast("binary"))


def ratio_table(docs: DataFrame, trusted: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """Log ratio per bucket in millionths, with one added to every count.

    ``docs`` (doc_id, text) gives the raw counts, those of its rows whose doc_id is in ``trusted``
    (doc_id) the target counts. Null ids are never trusted. The result has ``buckets`` numbers.
    """
    ids = trusted.select(F.col("doc_id").alias("trusted_id")).where("trusted_id IS NOT NULL").distinct()
    if small(ids, BROADCAST_IDS):
        ids = F.broadcast(ids)
    flagged = docs.select("doc_id", whole("text").alias("text")).join(
        ids, F.col("doc_id") == F.col("trusted_id"), "left"
    )
    words = flagged.select(F.col("trusted_id").isNotNull().cast("bigint").alias("target"), words_of(F.col("text")).alias("words"))
    pairs = words.select("target", F.inline(F.arrays_zip(F.col("words").alias("a"), F.expr("slice(words, 2, size(words))").alias("b"))))
    summed = pairs.select("target", _checksum(F.col("a")).alias("a"), _checksum(F.col("b")).alias("b"))
    grams = summed.select(
        "target",
        F.explode(F.array((F.col("a") % buckets).cast("int"), ((F.col("a") * PAIR + F.col("b")) % buckets).cast("int"))).alias("bucket"),
    ).where("bucket IS NOT NULL")  # the last word has no neighbour
    counted = grams.groupBy("bucket").agg(F.count("*").alias("raw"), F.sum("target").alias("target"))
    raw, target = [1] * buckets, [1] * buckets
    for row in counted.collect():  # at most one row per bucket
        raw[row["bucket"]] += row["raw"]
        target[row["bucket"]] += row["target"]
    all_raw, all_target = math.log(sum(raw)), math.log(sum(target))
    return [
        round(UNIT * ((math.log(t) - all_target) - (math.log(r) - all_raw)))
        for t, r in zip(target, raw, strict=True)
    ]


def _with_equal_neighbour(df: DataFrame, column: str) -> DataFrame:
    """Of a sorted array of (key, at), those elements whose key occurs twice or more."""

    def repeated(x: Column, i: Column) -> Column:
        before, after = F.get(column, i - 1)["key"], F.get(column, i + 1)["key"]
        return F.coalesce(x["key"] == before, F.lit(False)) | F.coalesce(x["key"] == after, F.lit(False))

    return df.withColumn(column, F.filter(column, repeated))


def quality_rules(
    docs: DataFrame,
    ratios: list[int],
    *,
    threshold: int = THRESHOLD,
    window: int = 5,
    min_words: int = 10,
    repeat_percent: int = 20,
) -> DataFrame:
    """Counts and verdict for every row of ``docs`` (doc_id, text).

    Null and empty texts have no words: all counts are 0, ``base_failed`` is true. Repeated rows
    and null ids are judged like any other row; further columns are left out, whatever their
    names. An empty table gives an empty result. A mean equal to the threshold is kept.
    """
    table = F.split(F.lit(",".join(map(str, ratios))), ",").cast("array<bigint>")
    texts = docs.select("doc_id", whole("text").alias("text"))
    split = texts.select("doc_id", "text", words_of(F.col("text")).alias("words"))
    lines = F.filter(F.split("text", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    counted = split.select(
        "doc_id",
        "words",
        F.size("words").cast("bigint").alias("n_words"),
        F.length(F.array_join("words", "")).cast("bigint").alias("word_chars"),
        F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("bigint").alias("n_symbols"),
        lines.alias("lines"),
        F.transform("words", _checksum).alias("single"),
    )
    paired = counted.withColumn(
        "pairs", F.zip_with("single", F.expr("slice(single, 2, size(single))"), lambda a, b: a * PAIR + b)
    )  # the last word has no neighbour, so its pair is null
    none = F.array().cast("array<bigint>")
    reach = [*range(0, window - 1, 2), *([window - 1] if window % 2 else [])]
    hashed = paired.select(
        "doc_id", "words", "n_words", "word_chars", "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        F.greatest(2 * F.col("n_words") - 1, F.lit(0)).cast("bigint").alias("n_grams"),
        (
            F.aggregate("single", F.lit(0).cast("bigint"), lambda total, c: total + F.get(table, c % len(ratios)))
            + F.aggregate(
                "pairs", F.lit(0).cast("bigint"),
                lambda total, p: total + F.coalesce(F.get(table, p % len(ratios)), F.lit(0)),
            )
        ).alias("llr_sum"),
        F.when(
            F.size("words") >= window,
            F.transform(
                F.sequence(F.lit(0), F.size("words") - window),
                lambda i: F.xxhash64(*[F.get("single" if k == window - 1 and window % 2 else "pairs", i + k) for k in reach]),
            ),
        ).otherwise(none).alias("windows"),
    )
    # Windows that may repeat, by number, are few; these are compared word for word.
    maybe = F.when(
        F.size(F.array_distinct("windows")) < F.size("windows"),
        F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("key"), i.alias("at")))),
    ).otherwise(F.array().cast("array<struct<key:bigint,at:int>>"))
    summed = hashed.select(
        "doc_id", "words", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_grams", "llr_sum", maybe.alias("ordered")
    )
    exact = _with_equal_neighbour(summed, "ordered").withColumn(
        "ordered",
        F.sort_array(F.transform("ordered", lambda x: F.struct(
            F.array_join(F.slice("words", x["at"] + 1, window), " ").alias("key"), x["at"].alias("at")
        ))),
    )
    places = _with_equal_neighbour(exact, "ordered").withColumn(
        "places", F.sort_array(F.transform("ordered", lambda x: x["at"]))
    )
    # Every place covers a window, less what the next place covers too.
    gaps = F.transform("places", lambda p, i: F.least(F.lit(window), F.coalesce(F.get("places", i + 1) - p, F.lit(window))))
    placed = places.withColumn("n_repeat_words", F.aggregate(gaps, F.lit(0).cast("bigint"), lambda total, g: total + g))
    base_failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > repeat_percent * F.col("n_words"))
    return placed.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed.alias("base_failed"),
        (~base_failed & (F.col("llr_sum") >= threshold * F.col("n_grams"))).alias("kept"),
        "n_grams", "llr_sum",
    )


# crc32 has no function in the other engine; the fixed polynomial of the checksum gives its table.
_SQL_CRC = """
crc_table AS (
    SELECT list(v ORDER BY n) AS t FROM (
        SELECT n, list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c % 2 = 1
            THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) AS r(n))
)"""


def sql(threshold: int = THRESHOLD, buckets: int = BUCKETS) -> str:
    """The same rows in DuckDB, with trusted ids from labels."""
    return rf"""
WITH {_SQL_CRC.strip()},
docs AS (
    SELECT doc_id, coalesce(text, '') AS text,
        regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
),
trusted AS (SELECT DISTINCT doc_id FROM labels WHERE quality = 1 AND toxic = 0),
tokens AS (
    SELECT doc_id, words[i] AS a, words[i + 1] AS b, i < len(words) AS paired
    FROM docs, unnest(range(1, len(words) + 1)) AS u(i)
),
checksums AS (
    SELECT word, xor(list_reduce(
        list_prepend(4294967295::BIGINT, list_transform(range(1, len(hex(encode(word))) // 2 + 1),
            lambda i: ('0x' || substr(hex(encode(word)), 2 * i - 1, 2))::BIGINT)),
        lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295::BIGINT) AS crc
    FROM (SELECT DISTINCT a AS word FROM tokens), crc_table
),
grams AS (
    SELECT doc_id, crc % {buckets} AS bucket FROM tokens JOIN checksums ON a = word
    UNION ALL
    SELECT doc_id, (x.crc * {PAIR} + y.crc) % {buckets} FROM tokens
    JOIN checksums x ON a = x.word JOIN checksums y ON b = y.word WHERE paired
),
hashed AS (
    SELECT bucket, count(*) AS raw, count(t.doc_id) AS target
    FROM grams g LEFT JOIN trusted t ON g.doc_id = t.doc_id GROUP BY bucket
),
sums AS (SELECT bucket, 1 + sum(raw) AS raw, 1 + sum(target) AS target FROM hashed GROUP BY bucket),
totals AS (
    SELECT {buckets} + coalesce(sum(raw - 1), 0) AS raw, {buckets} + coalesce(sum(target - 1), 0) AS target FROM sums
),
ratio AS (
    SELECT bucket, round({UNIT} * ((ln(s.target) - ln(t.target)) - (ln(s.raw) - ln(t.raw))))::BIGINT AS lr
    FROM sums s, totals t
),
scored AS (
    SELECT doc_id, count(*) AS n_grams, sum(lr) AS llr_sum
    FROM grams g JOIN ratio r ON g.bucket = r.bucket GROUP BY doc_id
),
windows AS (
    SELECT doc_id, i, list_aggregate(words[i:i + 4], 'string_agg', ' ') AS w
    FROM docs, unnest(range(1, len(words) - 3)) AS u(i)
),
marked AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w) AS n FROM windows),
covered AS (
    SELECT doc_id, count(DISTINCT p) AS n_repeat_words FROM (
        SELECT doc_id, unnest(range(i, i + 5)) AS p FROM marked WHERE n >= 2) GROUP BY doc_id
),
base AS (
    SELECT doc_id, len(words)::BIGINT AS n_words,
        length(array_to_string(words, ''))::BIGINT AS word_chars,
        len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
        list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines
    FROM docs
),
joined AS (
    SELECT b.*, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
        coalesce(n_grams, 0)::BIGINT AS n_grams, coalesce(llr_sum, 0)::BIGINT AS llr_sum
    FROM base b LEFT JOIN covered c ON b.doc_id = c.doc_id LEFT JOIN scored s ON b.doc_id = s.doc_id
)
SELECT doc_id, n_words, word_chars, n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
    NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND llr_sum >= {threshold} * n_grams AS kept,
    n_grams, llr_sum
FROM joined
"""
