"""Tweets from JSON lines, with a fixed schema: the file is never read to guess one."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from postsift.schemas import TWEET

_MODES = {"fail": "FAILFAST", "drop": "PERMISSIVE"}
_BAD = "_corrupt_record"


def read_tweets(
    spark: SparkSession,
    path: str | list[str],
    on_error: str = "drop",
    schema: T.StructType = TWEET,
    counts: Observation | None = None,
) -> DataFrame:
    """One row per line. A malformed line is dropped, or fails the job with ``"fail"``.

    With ``"drop"``, ``counts`` gets the numbers ``lines`` and ``bad_lines`` of the first action
    that reads all rows, in the same pass; ``counts.get`` has them afterwards.

    Whether a line is malformed is decided on the whole record, whatever columns are used later:
    broken JSON, and a field of another type than the schema's, drop the line.
    """
    if on_error not in _MODES:
        raise ValueError(f"unknown error rule: {on_error}")
    if on_error == "fail":
        return spark.read.schema(schema).option("mode", _MODES[on_error]).json(path)
    # Blank lines hold no record.
    lines = read_lines(spark, path).where(F.trim("value") != "")
    records = lines.select(_checked(F.col("value"), schema).alias("record"))
    bad = F.col("record").getField(_BAD).isNotNull()
    if counts is not None:
        records = records.observe(counts, F.count("*").alias("lines"), F.count_if(bad).alias("bad_lines"))
    fields = [F.col("record").getField(name).alias(name) for name in schema.names]
    return records.where(~bad).select(*fields)


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Raw lines as ``value``, nothing parsed."""
    return spark.read.text(path)


def parse_lines(
    lines: DataFrame, schema: T.StructType = TWEET, value: str = "value"
) -> DataFrame:
    """Parse a column of JSON text; a malformed text gives NULL fields."""
    return lines.select(F.from_json(F.col(value), schema).alias("record")).select("record.*")


def _checked(value: Column, schema: T.StructType) -> Column:
    """A record with one more field, which holds the text if any field can't be read."""
    checked = T.StructType([*schema.fields, T.StructField(_BAD, T.StringType())])
    return F.from_json(value, checked, {"columnNameOfCorruptRecord": _BAD})


def cast_columns(df: DataFrame, types: Mapping[str, str]) -> DataFrame:
    """Columns as other types, NULL where a value can't be read as one; the others stay."""
    unknown = sorted(set(types) - set(df.columns))
    if unknown:
        raise ValueError(f"no such columns: {', '.join(unknown)}")
    return df.withColumns({name: F.col(name).try_cast(kind) for name, kind in types.items()})


def bad_lines(lines: DataFrame, schema: T.StructType = TWEET, value: str = "value") -> DataFrame:
    """The lines that are not valid JSON of the schema, to count or to look at."""
    return lines.where(_checked(F.col(value), schema).getField(_BAD).isNotNull())


def flatten_tweets(df: DataFrame) -> DataFrame:
    """Nested fields as flat columns. Fields that are not used later are never parsed."""
    return df.select(
        "id",
        "content",
        F.col("user.username").alias("username"),
        F.col("user.location").alias("location"),
        "likeCount",
        "retweetCount",
        F.col("place.country").alias("country"),
        F.col("place.fullName").alias("fullName"),
    )


def register_views(
    spark: SparkSession,
    tweets: str | list[str] | None = None,
    keywords: Mapping[str, str] | None = None,
    lexicons: Mapping[str, str] | None = None,
) -> None:
    """Temp views for SQL users: flat ``tweets``, keyword lists (``value``), rated words."""
    from .lists import read_lexicon

    if tweets is not None:
        flatten_tweets(read_tweets(spark, tweets)).createOrReplaceTempView("tweets")
    for name, path in (keywords or {}).items():
        spark.read.text(path).createOrReplaceTempView(name)
    for name, path in (lexicons or {}).items():
        read_lexicon(spark, path).createOrReplaceTempView(name)
