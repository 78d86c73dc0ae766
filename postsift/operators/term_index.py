"""Term tables of middle size: one automaton over all terms, sent to the executors once.

A text is read once, whatever the number of terms, and nothing is shuffled. Terms and patterns are
looked up alike: a term is its own literal, a pattern is found through literals that all its matches
hold, and only the patterns found so are tried on the text, by Spark's own functions. A pattern
without such a literal is tried on every text; how many there are is logged.

The size of the table is measured before it is fetched; larger ones are joined.
"""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from postsift.defaults import INDEX_BYTES, INDEX_TERMS, INLINE_TERMS
from postsift.functions.matching import any_match, found_in, matched_terms, needle, searchable
from postsift.functions.text import let

from .literals import like_cover, regex_cover
from .terms import Terms, as_column, inline_terms

_log = logging.getLogger(__name__)

PATTERNS = {"like": like_cover, "regex": regex_cover}


@dataclass(frozen=True)
class _Parts:
    """What a task needs: literals with the entries they lead to, entries every text leads to,
    and the term of each entry, as often as it is listed."""

    literals: dict[str, list[int]]
    always: list[int]
    terms: list[list[str]]


class _Lookup:
    def __init__(self, parts: _Parts):
        self.parts = parts
        self.automaton = ahocorasick.Automaton()
        for literal, entries in parts.literals.items():
            self.automaton.add_word(literal, tuple(entries))
        if parts.literals:
            self.automaton.make_automaton()

    def hits(self, text: str) -> Any:
        return self.automaton.iter(text) if self.parts.literals else ()

    def terms_in(self, text: str | None) -> list[str] | None:
        if text is None:
            return None
        entries = {entry for held in {value for _, value in self.hits(text)} for entry in held}
        entries.update(self.parts.always)
        return [term for entry in sorted(entries) for term in self.parts.terms[entry]]

    def any_in(self, text: str | None) -> bool:
        if text is None:
            return False
        return bool(self.parts.always) or next(iter(self.hits(text)), None) is not None


_LOOKUPS: dict[str, Any] = {}


def _lookup_of(shared) -> _Lookup:
    """One automaton per table and worker process; a broadcast value is kept there as one object."""
    value = shared.value
    if value is not _LOOKUPS.get("parts"):
        _LOOKUPS.update(parts=value, lookup=_Lookup(value))
    return _LOOKUPS["lookup"]


class TermIndex:
    def __init__(self, terms: DataFrame, match: str, fold_keyword: bool):
        self.match, self.fold_keyword = match, fold_keyword
        sought = needle(F.col("term"), match, fold_keyword).alias("needle")
        rows = terms.groupBy("term").agg(F.count("*").alias("copies")).select("term", sought, "copies").collect()
        # Blank-only and empty literals are as good as any; only none at all is found everywhere.
        literals: dict[str, list[int]] = {}
        always: list[int] = []
        listed: list[list[str]] = []
        for row in sorted(rows, key=lambda row: row["term"]):
            if row["needle"] is None:
                continue
            cover = PATTERNS[match](row["needle"]) if match in PATTERNS else [row["needle"]]
            for literal in cover or [""]:
                (literals.setdefault(literal, []) if literal else always).append(len(listed))
            listed.append([row["term"]] * row["copies"])
        if always and match in PATTERNS:
            _log.warning("%d patterns without a literal are tried on every text", len(always))
        self.always = [listed[entry][0] for entry in always]
        self._shared = terms.sparkSession.sparkContext.broadcast(_Parts(literals, always, listed))

    def _asked(self, text: Column) -> Column:
        return F.lower(text) if self.match == "regex" else searchable(text, self.match)

    def _udf(self, kind: str, answer: Callable[[_Lookup, str | None], Any]) -> Callable[[Column], Column]:
        shared = self._shared
        arrow = {"array<string>": pa.list_(pa.string()), "boolean": pa.bool_()}[kind]

        @F.arrow_udf(kind)
        def looked_up(texts: pa.Array) -> pa.Array:
            lookup = _lookup_of(shared)
            return pa.array([answer(lookup, text.as_py()) for text in texts], arrow)

        return looked_up

    def found(self, text: Column) -> Column:
        """As ``matched_terms``."""
        candidates = self._udf("array<string>", _Lookup.terms_in)(self._asked(text))
        if self.match not in PATTERNS:
            return candidates
        both = F.struct(searchable(text, self.match).alias("body"), candidates.alias("terms"))
        return let(
            both,
            lambda given: F.filter(
                given["terms"],
                lambda term: found_in(given["body"], needle(term, self.match, self.fold_keyword), self.match),
            ),
        )

    def any(self, text: Column) -> Column:
        """As ``any_match``; a literal term ends the search of its text."""
        if self.match in PATTERNS:
            return F.coalesce(F.size(self.found(text)) > 0, F.lit(False))
        return self._udf("boolean", _Lookup.any_in)(self._asked(text))


def local_terms(terms: Terms, match: str, fold_keyword: bool) -> list[str] | TermIndex | None:
    """A short list as it is, one of middle size as an index, None for a larger one."""
    listed = inline_terms(terms)
    if listed is not None and len(listed) <= INLINE_TERMS:
        return listed
    if listed is not None:
        terms = SparkSession.active().createDataFrame([(term,) for term in listed], "term string")
    column = as_column(terms)
    size = column.agg(
        F.count_distinct("term").alias("rows"), F.sum(F.octet_length("term")).alias("size")
    ).first()
    if size["rows"] > INDEX_TERMS or size["size"] > INDEX_BYTES:
        return None
    return TermIndex(column, match, fold_keyword)


def matched(text: Column, terms: list[str] | TermIndex, match: str, fold_keyword: bool) -> Column:
    """Array of the terms in a text; NULL for NULL text."""
    if isinstance(terms, TermIndex):
        return terms.found(text)
    return matched_terms(text, terms, match, fold_keyword)


def any_of(text: Column, terms: list[str] | TermIndex, match: str, fold_keyword: bool) -> Column:
    """Whether a text holds a term; false for NULL text."""
    if isinstance(terms, TermIndex):
        return terms.any(text)
    return any_match(text, terms, match, fold_keyword)
