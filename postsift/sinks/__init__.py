"""Results to files. Writers use the executors; nothing passes through the driver."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postsift.operators.brands import report_lines

__all__ = [
    "write_count",
    "write_csv",
    "write_delimited",
    "write_json",
    "write_ranked",
    "write_report",
    "write_split",
]


def write_json(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.json(path, mode=mode)


# Fields keep their blanks and line ends; quotes inside one are doubled.
_WHOLE = {"escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}


def write_csv(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """With a header line. ``sources.read_table`` gets every field back whole."""
    df.write.csv(path, mode=mode, header=True, **_WHOLE)


def write_delimited(
    df: DataFrame, path: str, sep: str = "|", mode: str = "errorifexists"
) -> None:
    """Without a header line; a field that holds the delimiter or a line end is quoted."""
    df.write.csv(path, mode=mode, header=False, sep=sep, **_WHOLE)


def write_count(df: DataFrame, path: str, name: str = "numero", mode: str = "errorifexists") -> None:
    write_json(df.agg(F.count("*").alias(name)), path, mode)


def write_ranked(
    df: DataFrame, path: str, key: str, count: str = "count", mode: str = "errorifexists"
) -> None:
    """``key<TAB>count`` lines, most first: part files in name order are in rank order."""
    ranked = df.select(key, count).orderBy(F.desc(count), F.asc(key))
    ranked.write.csv(path, mode=mode, sep="\t", header=False, **_WHOLE)


def write_report(
    df: DataFrame,
    path: str,
    keys: Sequence[str],
    count: str = "count",
    width: int = 15,
    mode: str = "errorifexists",
) -> None:
    """Fixed-width lines in the order of ``df``."""
    report_lines(df, keys, count, width).write.mode(mode).text(path)


def write_split(
    df: DataFrame, path: str, by: str, format: str = "csv", mode: str = "overwrite"
) -> None:
    """One output folder per value of ``by`` (``by=value``), all from one pass."""
    writer = df.write.partitionBy(by).mode(mode)
    if format == "csv":
        writer.csv(path, header=True, **_WHOLE)
    elif format == "json":
        writer.json(path)
    else:
        raise ValueError(f"unknown format: {format}")
