"""Matching against a term table of any size, by equality joins only.

Searching every text for every term costs texts x terms. Here a term is found through the
words it touches instead: the longest blank-free piece of a term always lies inside one
blank-separated word of a text that holds the term. So pieces are looked up in the list of
distinct words (short strings, by their first characters), words lead to texts, and only
the candidates are checked against the whole text.

A term of three blank-separated parts or more holds whole words of the text, those between its ends.
It is looked up by the one of them that is in the fewest texts, and not at all if one is in none, so
that terms that share a frequent word don't all meet the texts with that word. Pieces of other terms
are cut out of the distinct words at the lengths that pieces with the same start have, and compared
as a whole: a start that many pieces share makes no more rows than a word has places and lengths.

Patterns have pieces too: those of the literals that all their matches hold. A pattern without one
is tried on every text, two thousand of them at a time; how many there are is logged.
"""

from __future__ import annotations

import logging

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postsift.functions.matching import found_in, matched_terms, needle, searchable
from postsift.functions.text import let
from postsift.storage import fits_in_memory, written

from .literals import like_cover, regex_cover, word_part
from .skew import spread_join
from .terms import as_column, slices

_log = logging.getLogger(__name__)

#: Length of the start of a piece that serves as join key.
GRAM = 3

#: Longer words are cut, parts overlapping by the longest piece.
LONG_WORD = 1_000

#: Words that hold no piece are left out by a table of so many hashes before they are moved.
HASHES = 1 << 24

#: Marks of pieces that are a whole word of a text, and of those that are a part of one.
WHOLE, PART = "=", "~"


def text_key(text: Column) -> Column:
    """32 bytes that stand for a text in joins and distincts, none for a missing text.

    Never NULL, so that no join has to compute it once more to leave NULLs out.
    """
    return F.coalesce(F.unhex(F.sha2(text, 256)), F.lit(b""))


def _pattern_pieces(match: str) -> Column:
    """Pieces of which every text with the pattern holds one; NULL if there are none."""

    @F.arrow_udf("array<string>")
    def pieces(needles: pa.Array) -> pa.Array:
        found = []
        for sought in needles.to_pylist():
            cover = (like_cover if match == "like" else regex_cover)(sought)
            parts = [word_part(literal) for literal in cover or [""]]
            found.append(sorted(set(parts)) if all(parts) else None)
        return pa.array(found, pa.list_(pa.string()))

    return pieces(F.col("needle"))


def _needles(terms: DataFrame, match: str, fold_keyword: bool) -> DataFrame:
    """``term, copies, needle, pieces, inner``; ``inner`` are the words between a term's ends."""
    listed = as_column(terms).groupBy("term").agg(F.count("*").alias("copies"))
    listed = listed.withColumn("needle", needle(F.col("term"), match, fold_keyword)).where("needle IS NOT NULL")
    if match in ("like", "regex"):
        none = F.array().cast("array<string>")
        return written(listed.withColumn("pieces", _pattern_pieces(match)).withColumn("inner", none))
    parts = F.split(F.col("needle"), " ")
    piece = F.array_max(
        F.transform(parts, lambda part: F.struct(F.length(part).alias("size"), part.alias("part")))
    )["part"]
    # Longer words of a text are cut.
    between = F.filter(
        F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 2, F.lit(0))),
        lambda part: (part != "") & (F.length(part) <= LONG_WORD),
    )
    return written(listed.withColumn("pieces", F.array(piece)).withColumn("inner", F.array_distinct(between)))


def _starts(word: Column, sizes: list[int]) -> Column:
    """``gram, start`` of every place of a word, for grams of the given lengths."""

    def of_size(size: int) -> Column:
        starts = F.sequence(F.lit(1), F.length(word) - (size - 1))
        cut = F.transform(
            starts, lambda start: F.struct(F.substring(word, start, F.lit(size)).alias("gram"), start.alias("start"))
        )
        return F.when(F.length(word) >= size, cut)

    none = F.array().cast("array<struct<gram: string, start: int>>")
    return F.concat(none, *[F.coalesce(of_size(size), none) for size in sizes])


def _words(text: Column, match: str, longest: int) -> Column:
    """The different words of a text, long ones in overlapping parts."""
    step = LONG_WORD + longest

    def parts(word: Column) -> Column:
        starts = F.sequence(F.lit(1), F.length(word), F.lit(LONG_WORD))
        cut = F.transform(starts, lambda start: F.substring(word, start, F.lit(step)))
        return F.when(F.length(word) > step, cut).otherwise(F.array(word))

    def cut(words: Column) -> Column:
        long = F.exists(words, lambda word: F.length(word) > step)
        return F.when(long, F.array_distinct(F.flatten(F.transform(words, parts)))).otherwise(words)

    return let(F.array_distinct(F.split(F.lower(text) if match == "regex" else searchable(text, match), " ")), cut)


def _by_inner_words(needles: DataFrame, counted: DataFrame) -> DataFrame:
    """The needles with whole words of the text that are all there, to be found by the rarest one."""
    sought = needles.where(F.size("inner") > 0).select("term", F.size("inner").alias("parts"), F.explode("inner").alias("piece"))
    listed = sought.select("piece").distinct()
    there = written(counted.join(listed, counted["word"] == listed["piece"]).select("piece", "texts"))
    best = (
        spread_join(sought, there, "piece", F.col("term"))
        .groupBy("term")
        .agg(F.first("parts").alias("parts"), F.count("*").alias("found"), F.min(F.struct("texts", "piece"))["piece"].alias("best"))
        .where("parts = found")
    )
    best = written(best.select("term", F.array(F.concat(F.lit(WHOLE), "best")).alias("pieces")))
    return spread_join(needles.drop("pieces"), best, "term", F.col("term"))


def _holding(counted: DataFrame, needles: DataFrame) -> DataFrame:
    """``word, piece`` for the distinct words that hold a piece."""
    pieces = needles.select(F.explode("pieces").alias("piece")).where("piece <> ''").distinct()
    pieces = written(pieces.withColumn("gram", F.substring("piece", 1, GRAM)))
    # At most GRAM different lengths.
    sizes = pieces.agg(F.collect_set(F.length("gram"))).first()[0]
    lengths = pieces.select("gram", F.length("piece").alias("size")).distinct()
    starts = counted.select("word", F.inline(_starts(F.col("word"), sorted(sizes))))
    cut = (
        spread_join(starts, written(lengths), "gram", F.struct("word", "start"))
        .where(F.col("start") + F.col("size") <= F.length("word") + 1)
        .select("word", F.substring("word", F.col("start"), F.col("size")).alias("piece"))
    )
    return spread_join(written(cut.distinct()), pieces.select("piece"), "piece", F.col("word")).select("word", "piece")


def _likely(words: DataFrame, touched: DataFrame) -> DataFrame:
    """The words that may be in a table, by a table of hashes of fixed size."""

    def place(word: str) -> Column:
        return F.xxhash64(word).bitwiseAND(F.lit(HASHES - 1))

    seen = np.zeros(HASHES, bool)
    seen[touched.select(place("word").cast("int").alias("place")).distinct().toArrow()["place"].to_numpy()] = True
    shared = words.sparkSession.sparkContext.broadcast(np.packbits(seen))

    @F.arrow_udf("boolean")
    def held(places: pa.Array) -> pa.Array:
        at = places.to_numpy()
        return pa.array((shared.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool))

    return words.where(held(place("word")))


def _touched(rows: DataFrame, needles: DataFrame, text: str, match: str) -> tuple[DataFrame, DataFrame]:
    """``__key, piece`` of the pieces in every text, and the needles that are left, with these pieces."""
    longest = needles.agg(F.max(F.array_max(F.transform("pieces", F.length)))).first()[0]
    words = rows.select("__key", F.explode(_words(F.col(text), match, longest or 0)).alias("word")).where("word <> ''")
    counted = written(words.groupBy("word").agg(F.count("*").alias("texts")))
    by_part = needles.where(F.size("inner") == 0)
    touched = _holding(counted, by_part).select("word", F.concat(F.lit(PART), "piece").alias("piece"))
    marked = F.transform("pieces", lambda piece: F.when(piece == "", piece).otherwise(F.concat(F.lit(PART), piece)))
    left = by_part.withColumn("pieces", marked)
    if match not in ("like", "regex"):
        by_word = _by_inner_words(needles.where(F.size("inner") > 0), counted)
        whole = by_word.select(F.get("pieces", F.lit(0)).alias("piece")).distinct()
        touched = touched.unionByName(whole.select(F.substring("piece", F.lit(2), F.length("piece")).alias("word"), "piece"))
        left = left.unionByName(by_word.select(*left.columns))
    touched = written(touched)
    if not fits_in_memory(touched):
        words = written(_likely(words, touched))
    return spread_join(words, touched, "word", F.col("__key")).select("__key", "piece").distinct(), written(left)


def _candidates(rows: DataFrame, needles: DataFrame, text: str, match: str) -> DataFrame:
    """``__key, term, needle, copies``: each text and the terms one of whose pieces it holds."""
    keys, left = _touched(rows, needles, text, match)
    listed = left.select("term", "needle", "copies", F.explode("pieces").alias("piece")).where("piece <> ''")
    if not fits_in_memory(listed):
        keys = written(keys)
    found = spread_join(keys, listed, "piece", F.col("__key")).select("__key", "term", "needle", "copies")
    return written(found.distinct() if match in ("like", "regex") else found)


def _blank_runs(text: str, match: str) -> Column:
    """The longest run of blanks: a text holds a blank term if it has a run as long."""
    runs = F.transform(
        F.regexp_extract_all(searchable(F.col(text), match), F.lit("( +)"), F.lit(1)), F.length
    )
    return F.coalesce(F.array_max(runs), F.lit(0))


def pairs_by_words(
    df: DataFrame,
    terms: DataFrame,
    text: str = "content",
    match: str = "contains",
    fold_keyword: bool = True,
    keyword: str = "keyword",
) -> DataFrame:
    """One row per (post, term) pair."""
    needles = _needles(terms, match, fold_keyword)
    rows = df.where(F.col(text).isNotNull()).withColumn("__key", text_key(F.col(text)))
    candidates = _candidates(rows, needles, text, match)
    columns = [F.col(name) for name in df.columns]
    repeated = F.array_repeat("term", F.col("copies").cast("int"))
    checked = (
        spread_join(rows, candidates, "__key", F.struct(*columns))
        .where(found_in(searchable(F.col(text), match), F.col("needle"), match))
        .select(*columns, F.explode(repeated).alias(keyword))
    )
    if match in ("like", "regex"):
        return _with_searched(checked, df, needles, text, match, fold_keyword, keyword)
    # Blank terms touch no word.
    blank = needles.where((F.get("pieces", F.lit(0)) == "") & (F.size("inner") == 0)).select(
        F.col("term"), "copies", F.length("needle").alias("__run")
    )
    if blank.isEmpty():
        return checked
    held = rows.withColumn("__run", F.explode(F.sequence(F.lit(0), _blank_runs(text, match))))
    blank_pairs = spread_join(held, blank, "__run", F.struct(*columns)).select(
        *columns, F.explode(repeated).alias(keyword)
    )
    return checked.unionByName(blank_pairs)


def _searched(needles: DataFrame) -> DataFrame:
    """The patterns without a literal, as often as they are listed."""
    rest = needles.where("pieces IS NULL")
    number = rest.count()
    if number:
        _log.warning("%d patterns without a literal are tried on every text", number)
    return rest.select(F.explode(F.array_repeat("term", F.col("copies").cast("int"))).alias("term"))


def _with_searched(
    checked: DataFrame, df: DataFrame, needles: DataFrame, text: str, match: str, fold_keyword: bool, keyword: str
) -> DataFrame:
    for part in slices(_searched(needles)):
        found = matched_terms(F.col(text), part, match, fold_keyword)
        checked = checked.unionByName(df.select("*", F.explode(found).alias(keyword)))
    return checked


def keys_by_words(
    df: DataFrame, terms: DataFrame, text: str = "content", match: str = "contains", fold_keyword: bool = True
) -> DataFrame:
    """``__key`` of every text that holds a term, once; pairs are not listed.

    A word that holds a whole term settles its text, so only the other texts are compared with the
    terms of more than one word.
    """
    needles = _needles(terms, match, fold_keyword)
    rows = df.select(text).where(F.col(text).isNotNull()).withColumn("__key", text_key(F.col(text)))
    by_piece, left = _touched(rows, needles, text, match)
    by_piece = written(by_piece)
    listed = left.withColumn("piece", F.explode("pieces"))
    if match == "contains":
        sure = listed.where(F.col("piece") == F.concat(F.lit(PART), "needle")).where("needle <> ''").select("piece").distinct()
    else:
        sure = listed.where(F.lit(False)).select("piece")
    settled = written(spread_join(by_piece, sure, "piece", F.col("__key")).select("__key").distinct())
    open_keys = by_piece.join(settled, "__key", "left_anti")
    unsure = listed.where("piece <> ''").select("needle", "piece").distinct()
    candidates = written(spread_join(open_keys, unsure, "piece", F.col("__key")).select("__key", "needle").distinct())
    checked = (
        spread_join(rows, candidates, "__key", F.col(text))
        .where(found_in(searchable(F.col(text), match), F.col("needle"), match))
        .select("__key")
    )
    hits = settled.unionByName(checked)
    if match in ("like", "regex"):
        for part in slices(_searched(needles)):
            found = matched_terms(F.col(text), part, match, fold_keyword)
            hits = hits.unionByName(rows.where(F.size(found) > 0).select("__key"))
        return hits.distinct()
    shortest = left.where(F.get("pieces", F.lit(0)) == "").agg(F.min(F.length("needle"))).first()[0]
    if shortest is not None:
        hits = hits.unionByName(rows.where(_blank_runs(text, match) >= shortest).select("__key"))
    return hits.distinct()
