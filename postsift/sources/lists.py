"""Keyword lists and rated word lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postsift.functions.text import stripped
from postsift.operators.sentiment import unique_words
from postsift.schemas import LEXICON


def read_keywords(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``keyword``, one per line as it is: blanks at the ends and empty lines are kept."""
    return spark.read.text(path).withColumnRenamed("value", "keyword")


def read_names(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``keyword`` without white space at the ends, each once."""
    return read_keywords(spark, path).select(stripped(F.col("keyword")).alias("keyword")).distinct()


def read_table(
    spark: SparkSession,
    path: str | list[str],
    schema: T.StructType | str,
    sep: str = ",",
    header: bool = True,
) -> DataFrame:
    """Rows that ``write_csv`` or ``write_delimited`` wrote, with line ends inside fields.

    A file is read by one task, since a line end does not always end a row; the writers give
    as many files as they have tasks.
    """
    # A missing field is an empty one without quotes: no text is read as NULL.
    whole = {"escape": '"', "multiLine": True, "lineSep": "\n", "nullValue": "\0", "emptyValue": ""}
    return spark.read.schema(schema).csv(path, sep=sep, header=header, **whole)


def read_lexicon(
    spark: SparkSession, path: str | list[str], duplicates: str = "reject"
) -> DataFrame:
    """``word, rating`` from tab-separated lines.

    A word rated twice would count twice per occurrence: it is rejected unless
    ``duplicates="keep"``.
    """
    if duplicates not in ("reject", "keep"):
        raise ValueError(f"unknown rule for duplicates: {duplicates}")
    lexicon = spark.read.schema(LEXICON).csv(path, sep="\t", quote="")
    return unique_words(lexicon) if duplicates == "reject" else lexicon
