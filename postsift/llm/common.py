"""What several operators share: tables, words, and intermediate results."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import count

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Characters, or bytes, of a part of a batch that is worked on at once.
PART_SIZE = 1 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def words_of(text: Column) -> Column:
    """Words of a text as an array; none for null.

    Splitting on one blank is several times faster than on a class of them.
    """
    text = F.coalesce(text, F.lit(""))
    for blank in "\t\n\x0b\x0c\r":
        text = F.replace(text, F.lit(blank), F.lit(" "))
    return F.array_remove(F.split(text, " "), "")


def whole(text: str | Column) -> Column:
    """A text, empty where it is null."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def bucket_of(doc_id: str, parts: int) -> Column:
    """crc32 of an id written as text, modulo a number of folds; null ids count as empty."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % parts


def small(df: DataFrame, rows: int) -> bool:
    """Whether a table has at most so many rows; looks at no more than it needs."""
    return df.limit(rows + 1).count() <= rows


def unused(name: str, df: DataFrame) -> str:
    """A name like the given one that no column of a table has."""
    return next(n for n in (f"{name}{i or ''}" for i in count()) if n.lower() not in map(str.lower, df.columns))


def parts(batch: pd.Series | pd.DataFrame, *columns: str, size: int = PART_SIZE) -> Iterator[pd.Series | pd.DataFrame]:
    """A batch of texts or bytes in parts of bounded size, in order; a larger row is a part of its own.

    Batches hold thousands of rows whatever their length. What is worked out for a part is gone
    before the next one, so a worker holds the batch and little else. ``columns`` are those that
    count, for a table. An empty batch has no parts.
    """
    values = [batch[name] for name in columns] if columns else [batch]
    start = held = 0
    for end, row in enumerate(zip(*values, strict=True)):
        length = sum(map(len, row))
        if end > start and held + length > size:
            yield batch.iloc[start:end]
            start, held = end, 0
        held += length
    if start < len(batch):
        yield batch.iloc[start:]
