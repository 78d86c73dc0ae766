"""Posts and keyword lists: pairs, censoring, stances and user rankings."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache, cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from postsift.defaults import ANTI_LABEL, PRO_LABEL
from postsift.functions.text import let
from postsift.storage import fits_in_memory, written

from .term_index import TermIndex, any_of, local_terms, matched
from .term_join import keys_by_words, pairs_by_words, text_key
from .terms import Terms


class Censored:
    """``matches, kept``; of a table of any size each is worked out when it is first asked for."""

    def __init__(self, matches: Callable[[], DataFrame], kept: Callable[[], DataFrame]):
        self._matches, self._kept = matches, kept

    @cached_property
    def matches(self) -> DataFrame:
        return self._matches()

    @cached_property
    def kept(self) -> DataFrame:
        return self._kept()

    def __iter__(self) -> Iterator[DataFrame]:
        return iter((self.matches, self.kept))


def keyword_pairs(
    df: DataFrame,
    keywords: Terms,
    text: str = "content",
    match: str = "contains",
    fold_keyword: bool = True,
    keyword: str = "keyword",
) -> DataFrame:
    """One row per (post, keyword) pair: the post's columns and ``keyword``.

    A short list becomes part of the scan stage, a table of middle size is looked up there. A
    longer one is joined by the words it touches, patterns by words that their matches hold.
    """
    terms = local_terms(keywords, match, fold_keyword)
    if terms is not None:
        return _inline_pairs(df, terms, text, match, fold_keyword, keyword)
    return pairs_by_words(df, keywords, text, match, fold_keyword, keyword)


def _inline_pairs(
    df: DataFrame, terms: list[str] | TermIndex, text: str, match: str, fold_keyword: bool, keyword: str
) -> DataFrame:
    found = matched(F.col(text), terms, match, fold_keyword)
    return df.select("*", F.explode(found).alias(keyword))


def with_match_count(
    df: DataFrame,
    keywords: Terms,
    name: str,
    text: str = "content",
    match: str = "contains",
    fold_keyword: bool = True,
) -> DataFrame:
    """Add the number of keywords each post holds, 0 for NULL text."""
    terms = local_terms(keywords, match, fold_keyword)
    if terms is None:
        return _count_by_join(df, keywords, name, text, match, fold_keyword)
    found = matched(F.col(text), terms, match, fold_keyword)
    return df.withColumn(name, F.coalesce(F.size(found), F.lit(0)))


def _count_by_join(
    df: DataFrame, keywords: DataFrame, name: str, text: str, match: str, fold_keyword: bool
) -> DataFrame:
    """The same from a table of any size: pairs are counted per text, by the text's key.

    Equal texts are found equally often, so their pairs are divided by their number.
    """
    key = text_key(F.col(text)).alias("__key")
    pairs = keyword_pairs(df.select(text), keywords, text, match, fold_keyword, "__keyword")
    found = pairs.groupBy(key).agg(F.count("*").alias("__pairs"))
    copies = df.where(F.col(text).isNotNull()).groupBy(key).agg(F.count("*").alias("__copies"))
    each = written(
        found.join(copies, "__key").select("__key", F.expr("__pairs div __copies").cast("int").alias(name))
    )
    keyed = df.withColumn("__key", text_key(F.col(text)))
    if fits_in_memory(each):
        each = F.broadcast(each)
    joined = keyed.join(each, "__key", "left")
    return joined.select(*df.columns, F.coalesce(name, F.lit(0)).alias(name))


def matched_posts(
    df: DataFrame,
    keywords: Terms,
    text: str = "content",
    match: str = "contains",
    fold_keyword: bool = True,
) -> DataFrame:
    """Each post with at least one keyword, once."""
    return censor(df, keywords, "anti", "tweets", text, match, fold_keyword).matches


def censor(
    df: DataFrame,
    keywords: Terms,
    remainder: str = "except",
    count: str = "pairs",
    text: str = "content",
    match: str = "contains",
    fold_keyword: bool = True,
) -> Censored:
    """Split posts into those that hold a keyword and the rest.

    ``count`` says whether a match is listed per keyword (``pairs``) or once (``tweets``).
    ``remainder="except"`` keeps each different remaining row once, ``"anti"`` keeps every
    remaining row. Whether a row stays depends on its own text alone, so neither form has
    to be joined with the matches: ``anti`` is a filter, ``except`` a filter and a distinct.
    """
    if remainder not in ("except", "anti"):
        raise ValueError(f"unknown remainder: {remainder}")
    if count not in ("pairs", "tweets"):
        raise ValueError(f"unknown count: {count}")
    terms = local_terms(keywords, match, fold_keyword)
    if terms is None:
        return _censor_by_join(df, keywords, remainder, count, text, match, fold_keyword)
    hit = any_of(F.col(text), terms, match, fold_keyword)
    if count == "pairs":
        matches = _inline_pairs(df, terms, text, match, fold_keyword, "__keyword").drop("__keyword")
    else:
        matches = df.where(hit)
    kept = df.where(~hit)
    return Censored(lambda: matches, lambda: kept.distinct() if remainder == "except" else kept)


def _censor_by_join(
    df: DataFrame,
    keywords: DataFrame,
    remainder: str,
    count: str,
    text: str,
    match: str,
    fold_keyword: bool,
) -> Censored:
    """Whether a text holds a term is looked up by its key; pairs are only listed if they count."""
    keyed = df.withColumn("__key", text_key(F.col(text)))

    @cache
    def hits() -> DataFrame:
        found = written(keys_by_words(df, keywords, text, match, fold_keyword))
        return F.broadcast(found) if fits_in_memory(found) else found

    def kept() -> DataFrame:
        rest = keyed.join(hits(), "__key", "left_anti").drop("__key")
        return rest.distinct() if remainder == "except" else rest

    def matches() -> DataFrame:
        if count == "pairs":
            return pairs_by_words(df, keywords, text, match, fold_keyword, "__keyword").drop("__keyword")
        return keyed.join(hits(), "__key", "left_semi").drop("__key")

    return Censored(matches, kept)


def with_any_match(
    df: DataFrame,
    keywords: Terms,
    name: str,
    text: str = "content",
    match: str = "contains",
    fold_keyword: bool = True,
) -> DataFrame:
    """Add whether a post holds at least one keyword; false for NULL text."""
    terms = local_terms(keywords, match, fold_keyword)
    if terms is not None:
        return df.withColumn(name, any_of(F.col(text), terms, match, fold_keyword))
    hits = written(keys_by_words(df, keywords, text, match, fold_keyword)).withColumn(name, F.lit(True))
    if fits_in_memory(hits):
        hits = F.broadcast(hits)
    joined = df.withColumn("__key", text_key(F.col(text))).join(hits, "__key", "left")
    return joined.select(*df.columns, F.coalesce(name, F.lit(False)).alias(name))


def count_matches(
    df: DataFrame,
    keywords: Terms,
    count: str = "pairs",
    text: str = "content",
    match: str = "contains",
    fold_keyword: bool = True,
    name: str = "numero",
) -> DataFrame:
    """One row with the number of pairs, or of posts that hold a keyword."""
    terms = local_terms(keywords, match, fold_keyword)
    if terms is None:
        parts = censor(df.select(text), keywords, "anti", count, text, match, fold_keyword)
        return parts.matches.agg(F.count("*").alias(name))
    if count == "tweets":
        hit = any_of(F.col(text), terms, match, fold_keyword)
        return df.where(hit).agg(F.count("*").alias(name))
    counted = with_match_count(df, terms, "__n", text, match, fold_keyword)
    return counted.agg(F.coalesce(F.sum(F.col("__n").cast("bigint")), F.lit(0)).alias(name))


def stance_totals(
    df: DataFrame,
    pro: Terms,
    anti: Terms,
    count: str = "pairs",
    text: str = "content",
    match: str = "contains",
    fold_keyword: bool = True,
    labels: tuple[str, str] = (PRO_LABEL, ANTI_LABEL),
) -> DataFrame:
    """``tipo, numero``: matches of both lists, from one pass over the posts."""
    sides = [local_terms(side, match, fold_keyword) for side in (pro, anti)]
    if None in sides:
        totals = [
            count_matches(df, terms, count, text, match, fold_keyword).select(
                F.lit(label).alias("tipo"), "numero"
            )
            for terms, label in zip((pro, anti), labels)
        ]
        return totals[0].unionByName(totals[1])
    measures = []
    for terms in sides:
        if count == "pairs":
            size = F.coalesce(
                F.size(matched(F.col(text), terms, match, fold_keyword)), F.lit(0)
            )
        else:
            size = any_of(F.col(text), terms, match, fold_keyword).cast("int")
        measures.append(F.coalesce(F.sum(size.cast("bigint")), F.lit(0)))
    totals = df.agg(measures[0].alias("pro"), measures[1].alias("anti"))
    rows = F.array(
        F.struct(F.lit(labels[0]).alias("tipo"), F.col("pro").alias("numero")),
        F.struct(F.lit(labels[1]).alias("tipo"), F.col("anti").alias("numero")),
    )
    return totals.select(F.inline(rows))


def stance_pairs(
    df: DataFrame,
    pro: Terms,
    anti: Terms,
    text: str = "content",
    match: str = "contains",
    fold_keyword: bool = True,
    labels: tuple[str, str] = (PRO_LABEL, ANTI_LABEL),
) -> DataFrame:
    """One row per (post, list, keyword) with ``tipo`` and ``keyword``, from one pass."""
    sides = [local_terms(side, match, fold_keyword) for side in (pro, anti)]
    if None in sides:
        parts = [
            keyword_pairs(df, terms, text, match, fold_keyword).withColumn("tipo", F.lit(label))
            for terms, label in zip((pro, anti), labels)
        ]
        pairs = parts[0].unionByName(parts[1])
        return pairs.select(*df.columns, "tipo", "keyword")

    def labelled(terms: list[str] | TermIndex, label: str) -> Column:
        found = matched(F.col(text), terms, match, fold_keyword)
        return F.transform(
            found, lambda term: F.struct(F.lit(label).alias("tipo"), term.alias("keyword"))
        )

    found = F.concat(*[labelled(terms, label) for terms, label in zip(sides, labels)])
    return df.select("*", F.inline(found))


def stance_overlap(
    df: DataFrame,
    pro: Terms,
    anti: Terms,
    text: str = "content",
    match: str = "contains",
    fold_keyword: bool = True,
) -> DataFrame:
    """The posts that hold a keyword of either list, with ``pro``, ``anti``, ``overlap``.

    ``pro`` and ``anti`` are the numbers of keywords found.
    """
    sides = [local_terms(side, match, fold_keyword) for side in (pro, anti)]
    if None in sides:
        counted = with_match_count(df, pro, "pro", text, match, fold_keyword)
        counted = with_match_count(counted, anti, "anti", text, match, fold_keyword)
        both = (F.col("pro") > 0) & (F.col("anti") > 0)
        return counted.where((F.col("pro") > 0) | (F.col("anti") > 0)).withColumn("overlap", both)
    numbers = []
    for name, listed in zip(("pro", "anti"), sides):
        found = matched(F.col(text), listed, match, fold_keyword)
        numbers.append(F.coalesce(F.size(found), F.lit(0)).alias(name))
    # A list of one entry or none keeps the search from being repeated in a filter.
    marked = let(
        F.struct(*numbers),
        lambda n: F.when(
            (n["pro"] > 0) | (n["anti"] > 0),
            F.array(
                F.struct(
                    n["pro"].alias("pro"),
                    n["anti"].alias("anti"),
                    ((n["pro"] > 0) & (n["anti"] > 0)).alias("overlap"),
                )
            ),
        ),
    )
    return df.select("*", F.inline(marked))


def rank_users(
    df: DataFrame,
    keywords: Terms,
    count: str = "pairs",
    user: str = "username",
    text: str = "content",
    match: str = "contains",
    fold_keyword: bool = True,
) -> DataFrame:
    """``username, count``: users by their matches, most first, ties by name."""
    narrow = df.select(user, text)
    if count == "pairs":
        hits = keyword_pairs(narrow, keywords, text, match, fold_keyword)
    else:
        hits = matched_posts(narrow, keywords, text, match, fold_keyword)
    counts = hits.groupBy(user).agg(F.count("*").alias("count"))
    return counts.orderBy(F.desc("count"), F.asc(user))
