"""Every query against the same question in plain SQL."""

from collections import Counter
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from postsift.plans import oracle
from postsift.plans import queries as registry

SF = "/root/testdata/sf0.001"
QUERIES, ORACLE = registry.queries(), oracle.oracle_sql()

pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="tables are not here")


@pytest.fixture(scope="module")
def database():
    connection = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, database, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    found = Counter(tuple(row[column] for column in columns) for row in df.collect())
    assert found
    if name not in ORACLE:
        return
    result = database.execute(ORACLE[name])
    names = [column[0] for column in result.description]
    assert sorted(names) == columns
    order = [names.index(column) for column in columns]
    assert found == Counter(tuple(row[i] for i in order) for row in result.fetchall())


def test_every_sql_has_a_query():
    assert set(ORACLE) <= set(QUERIES) <= set(entry.queries())
    assert set(ORACLE) <= set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    assert entry.entry(spark).columns == ["username", "count"]
