"""Term lists: short ones travel inside the plan, long ones stay tables."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import islice

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postsift.defaults import INLINE_BYTES, INLINE_TERMS, SLICE_TERMS

#: A list of terms, or a table of them whose first column holds the term.
Terms = Sequence[str] | DataFrame


def as_column(terms: DataFrame) -> DataFrame:
    first = terms.columns[0]
    return terms.select(F.col(first).alias("term")).where(F.col("term").isNotNull())


def inline_terms(terms: Terms) -> list[str] | None:
    """The terms as a local list, or None when the table is too large for a plan.

    The size is looked up before anything is fetched.
    """
    if not isinstance(terms, DataFrame):
        return list(terms)
    column = as_column(terms)
    size = column.agg(
        F.count("*").alias("rows"), F.coalesce(F.sum(F.octet_length("term")), F.lit(0)).alias("size")
    ).first()
    if size["rows"] > INLINE_TERMS or size["size"] > INLINE_BYTES:
        return None
    return [row["term"] for row in column.collect()]


def slices(terms: DataFrame, size: int = SLICE_TERMS) -> Iterator[list[str]]:
    """The table in local pieces of at most ``size`` terms."""
    rows = (row["term"] for row in as_column(terms).toLocalIterator())
    while piece := list(islice(rows, size)):
        yield piece
