from .lists import read_keywords, read_lexicon, read_names, read_table
from .tweets import (
    bad_lines,
    cast_columns,
    flatten_tweets,
    parse_lines,
    read_lines,
    read_tweets,
    register_views,
)

__all__ = [
    "bad_lines",
    "cast_columns",
    "flatten_tweets",
    "parse_lines",
    "read_keywords",
    "read_lexicon",
    "read_lines",
    "read_names",
    "read_table",
    "read_tweets",
    "register_views",
]
