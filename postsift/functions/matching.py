"""Which terms of a short list occur in a text, as Columns.

The list is part of the expression: no join, no shuffle, one lower-casing per text, and a
row only ever grows to the terms it really holds.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import let, one_line

#: ``contains`` literal substring, ``like`` SQL wildcards in the term, ``regex`` the term is
#: a pattern, ``spaced`` a blank on both sides, ``word`` whole words only.
MATCHES = ("contains", "like", "regex", "spaced", "word")

_NOT_WORD = r"[^\p{L}\p{N}]+"
_NO_WORDS = "  "

#: Up to this many patterns are compiled once per task, more once per text.
CONSTANT_PATTERNS = 64


def _words_only(text: Column) -> Column:
    words = F.trim(F.regexp_replace(text, _NOT_WORD, " "))
    return F.concat(F.lit(" "), words, F.lit(" "))


def searchable(text: Column, match: str) -> Column:
    """The form of the text in which ``needle`` is searched."""
    if match == "regex":
        return text
    lowered = F.lower(text)
    if match == "spaced":
        return one_line(lowered)
    if match == "word":
        return _words_only(lowered)
    if match in ("contains", "like"):
        return lowered
    raise ValueError(f"unknown match: {match}")


def needle(term: Column, match: str, fold_keyword: bool) -> Column:
    """The form of a term that is searched in ``searchable`` text."""
    if match == "regex":
        return term
    folded = F.lower(term) if fold_keyword else term
    if match == "spaced":
        return F.concat(F.lit(" "), folded, F.lit(" "))
    if match == "word":
        # A term without a word in it is never found.
        words = _words_only(folded)
        return F.when(words != _NO_WORDS, words)
    return folded


def _text_array(json_text: Column) -> Column:
    """A constant array from one literal: thousands of literals take seconds to set up."""
    return F.from_json(json_text, "array<string>")


def _needles(terms: list[str], match: str, fold_keyword: bool) -> Column:
    """``needle`` of every term, as a constant the planner works out once."""

    def fold(text: Column) -> Column:
        return F.lower(text) if fold_keyword else text

    if match == "word":
        lines = F.lit("\n".join(term.replace("\n", " ") for term in terms))
        words = F.regexp_replace(fold(lines), r"[^\p{L}\p{N}\n]+", " ")
        words = F.trim(F.regexp_replace(words, r" *\n *", "\n"))
        spaced = F.concat(F.lit(" "), F.regexp_replace(words, "\n", " \n "), F.lit(" "))
        return F.split(spaced, "\n")
    listed = [f" {term} " for term in terms] if match == "spaced" else terms
    text = F.lit(json.dumps(listed, ensure_ascii=False))
    return _text_array(text if match == "regex" else fold(text))


def found_in(text: Column, sought: Column, match: str) -> Column:
    """Whether a ``needle`` is in a ``searchable`` text."""
    if match == "like":
        return F.like(text, F.concat(F.lit("%"), sought, F.lit("%")))
    if match == "regex":
        # The whole text has to match, and a dot stops at a line end.
        return F.rlike(text, F.concat(F.lit(r"\A(?:(?i).*"), sought, F.lit(r".*)\z")))
    if match == "word":
        return F.contains(text, sought) & (sought != _NO_WORDS)
    return F.contains(text, sought)


def _either(conditions: list[Column]) -> Column:
    """OR as a flat tree: a chain of a thousand would overflow the stack of the planner."""
    if len(conditions) == 1:
        return conditions[0]
    half = len(conditions) // 2
    return _either(conditions[:half]) | _either(conditions[half:])


def _constant_patterns(terms: Sequence[str], match: str) -> bool:
    return match in ("like", "regex") and len(terms) <= CONSTANT_PATTERNS


def _by_wildcards(terms: list[str], match: str) -> tuple[list[str], list[str]]:
    """The terms of a ``like`` list that are plain substrings, and the others."""
    if match != "like":
        return [], terms
    plain: list[str] = []
    wild: list[str] = []
    for term in terms:
        (wild if any(sign in term for sign in "%_\\") else plain).append(term)
    return plain, wild


def _with_text(text: Column, match: str, body: Callable[[Column], Column]) -> Column:
    return let(searchable(text, match), body)


def matched_terms(
    text: Column,
    terms: Sequence[str],
    match: str = "contains",
    fold_keyword: bool = True,
) -> Column:
    """Array of the terms found in ``text``; NULL for NULL text.

    A term listed twice is found twice. The text is always compared in lower case except
    by ``regex``, which ignores case by itself; ``fold_keyword=False`` leaves the terms
    as they are, so one with a capital letter is never found.
    """
    terms = list(terms)
    if not terms:
        return F.when(text.isNotNull(), F.array().cast("array<string>"))
    plain, wild = _by_wildcards(terms, match)
    if plain:
        found_plain = matched_terms(text, plain, "contains", fold_keyword)
        return F.concat(found_plain, matched_terms(text, wild, match, fold_keyword))
    if _constant_patterns(terms, match):

        def found(body: Column) -> Column:
            conditions = [
                F.when(found_in(body, needle(F.lit(term), match, fold_keyword), match), F.lit(term))
                for term in terms
            ]
            return F.array_compact(F.array(*conditions))

    else:
        listed = _text_array(F.lit(json.dumps(terms, ensure_ascii=False)))
        needles = _needles(terms, match, fold_keyword)

        def found(body: Column) -> Column:
            return F.filter(
                listed, lambda _, index: found_in(body, F.get(needles, index), match)
            )

    return _with_text(text, match, lambda body: F.when(body.isNotNull(), found(body)))


def any_match(
    text: Column,
    terms: Sequence[str],
    match: str = "contains",
    fold_keyword: bool = True,
) -> Column:
    """Whether ``text`` holds at least one term; false for NULL text, never NULL."""
    terms = list(terms)
    if not terms:
        return F.lit(False)
    plain, wild = _by_wildcards(terms, match)
    if plain:
        plain_hit = any_match(text, plain, "contains", fold_keyword)
        return plain_hit | any_match(text, wild, match, fold_keyword)
    if _constant_patterns(terms, match):

        def hit(body: Column) -> Column:
            return _either(
                [found_in(body, needle(F.lit(term), match, fold_keyword), match) for term in terms]
            )

    else:
        needles = _needles(terms, match, fold_keyword)

        def hit(body: Column) -> Column:
            return F.exists(needles, lambda sought: found_in(body, sought, match))

    return F.coalesce(_with_text(text, match, hit), F.lit(False))
