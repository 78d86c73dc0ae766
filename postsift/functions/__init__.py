from .matching import MATCHES, any_match, matched_terms
from .text import (
    clean_tokens,
    left_justified,
    let,
    one_line,
    state_of,
    stop_words,
    stripped,
    tokens,
    word_counts,
)

__all__ = [
    "MATCHES",
    "any_match",
    "clean_tokens",
    "left_justified",
    "let",
    "matched_terms",
    "one_line",
    "state_of",
    "stop_words",
    "stripped",
    "tokens",
    "word_counts",
]
