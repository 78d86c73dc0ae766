"""Column functions over text. All of them stay on the JVM and inside one row."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import Column
from pyspark.sql import functions as F

from postsift.defaults import EXTRA_STOP_WORDS

# Separators of the two tokenizers and of the word cleaner.
WHITESPACE = r"\s+"
DELIMITERS = r'[ ",()*]+'
WORD_BREAKS = r'\s,;:@#$%&?!"()\[\]{}<>'
AFTER_COMMA = r"[^,]+,\s*(.*)"

# Letters and digits from one break to the next, with nothing but one period in between.
_CLEAN_WORD = rf"(?<![^{WORD_BREAKS}])[\p{{L}}\p{{N}}]++(?=\.?(?:[{WORD_BREAKS}]|\z))"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it in ``body`` as often as needed.

    A column that is only aliased may be copied by the optimizer into every place that
    uses it, inside a lambda even once per element. A lambda variable is not copied.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def stripped(text: Column) -> Column:
    """Both ends without white space of any kind, not just blanks."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def one_line(text: Column) -> Column:
    return F.replace(text, F.lit("\n"), F.lit(" "))


def state_of(full_name: Column, rule: str = "second") -> Column:
    """State part of a place such as ``Austin, TX``; NULL where there is none.

    ``second`` takes the second part between ``", "``, ``after_comma`` everything that
    follows the first comma.
    """
    if rule == "second":
        return F.get(F.split(full_name, ", "), F.lit(1))
    if rule == "after_comma":
        return F.when(
            full_name.rlike(AFTER_COMMA), F.regexp_extract(full_name, AFTER_COMMA, 1)
        )
    raise ValueError(f"unknown state rule: {rule}")


def tokens(text: Column, rule: str = "whitespace") -> Column:
    """Split text on white space, or on the delimiters blank ``" , ( ) *``."""
    if rule == "whitespace":
        return F.split(text, WHITESPACE)
    if rule == "delimiters":
        return F.filter(F.split(text, DELIMITERS), lambda token: token != "")
    raise ValueError(f"unknown token rule: {rule}")


def stop_words(extra: Sequence[str] = EXTRA_STOP_WORDS) -> list[str]:
    return sorted({*StopWordsRemover.loadDefaultStopWords("english"), *extra})


def clean_tokens(text: Column, stop: Sequence[str] | None = None) -> Column:
    """Lower-case alphanumeric words that are not stop words, in text order.

    A word loses one final period; a word with any other sign inside (a hyphen, an
    apostrophe) is dropped whole.
    """
    stop = stop_words() if stop is None else list(stop)
    words = F.regexp_extract_all(F.lower(text), F.lit(_CLEAN_WORD), F.lit(0))
    return F.filter(words, lambda word: ~word.isin(stop))


def word_counts(words: Column) -> Column:
    """Array of ``term, count``, one entry per different word; NULL without any word.

    Words are sorted inside the row and counted by the distance between the places where
    the word changes.
    """

    def counted(ordered: Column) -> Column:
        starts = F.filter(
            F.sequence(F.lit(1), F.size(ordered)),
            lambda at: (at == 1) | (F.get(ordered, at - 1) != F.get(ordered, at - 2)),
        )
        return let(
            starts,
            lambda first: F.transform(
                first,
                lambda at, index: F.struct(
                    F.get(ordered, at - 1).alias("term"),
                    (F.coalesce(F.get(first, index + 1), F.size(ordered) + 1) - at)
                    .cast("bigint")
                    .alias("count"),
                ),
            ),
        )

    return let(
        F.sort_array(words), lambda ordered: F.when(F.size(ordered) > 0, counted(ordered))
    )


def left_justified(text: Column, width: int = 15) -> Column:
    """Pad with blanks on the right to ``width``; longer text stays whole."""
    return F.format_string(f"%-{width}s", text)
