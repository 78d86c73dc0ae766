"""Brand mentions: trend, by place, printed report."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postsift.defaults import BRANDS, UNKNOWN_LOCATION
from postsift.functions.text import left_justified, stripped

from .keywords import keyword_pairs
from .terms import Terms


def brand_names(brands: Terms) -> Terms:
    """The list without white space at the ends and without repeats."""
    if isinstance(brands, DataFrame):
        return brands.select(stripped(F.col(brands.columns[0])).alias("restaurant")).distinct()
    return sorted({name.strip() for name in brands})


def mentions(df: DataFrame, brands: Terms = BRANDS, text: str = "content") -> DataFrame:
    """One row per (post, brand) pair. The text is lowered, the brands are not."""
    return keyword_pairs(
        df, brand_names(brands), text, fold_keyword=False, keyword="restaurant"
    )


def brand_trend(df: DataFrame, brands: Terms = BRANDS, text: str = "value") -> DataFrame:
    """``restaurant, count``: mentions in whole raw lines, most first.

    Give it lines as read from the file: a brand found in any field of the record counts.
    For the text alone name its column.
    """
    lines = df.select(stripped(F.col(text)).alias("line"))
    counts = mentions(lines, brands, "line").groupBy("restaurant").agg(F.count("*").alias("count"))
    return counts.orderBy(F.desc("count"), F.asc("restaurant"))


def brand_by_location(
    df: DataFrame,
    brands: Terms = BRANDS,
    text: str = "content",
    location: str = "location",
    unknown: str = UNKNOWN_LOCATION,
) -> DataFrame:
    """``restaurant, location, count``: mentions per brand and lower-case user location."""
    placed = df.select(
        text, F.lower(F.coalesce(F.col(location), F.lit(unknown))).alias("location")
    )
    counts = (
        mentions(placed, brands, text)
        .groupBy("restaurant", "location")
        .agg(F.count("*").alias("count"))
    )
    return counts.orderBy("restaurant", "location")


def report_lines(df: DataFrame, keys: Sequence[str], count: str = "count", width: int = 15) -> DataFrame:
    """``value``: keys padded to ``width`` and the count, separated by tabs."""
    parts = [left_justified(F.col(key), width) for key in keys]
    return df.select(F.concat_ws("\t", *parts, F.col(count).cast("string")).alias("value"))
