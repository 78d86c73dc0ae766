"""Every query of the subpackage against plain SQL, and the pipeline stage by stage."""

import hashlib
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken

import corpus_pipeline
from postsift import llm
from postsift.llm.op07_byte_bpe import read_ranks

from .brute import brute_bytes, brute_components

SF = "/root/testdata/sf0.001"
QUERIES, ORACLE = llm.queries(), llm.oracle_sql()

pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="tables are not here")


@pytest.fixture(scope="module")
def database():
    connection = duckdb.connect()
    for path in Path(SF).glob("*.parquet"):
        connection.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return connection


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_against_sql(spark, database, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    found = Counter(tuple(row[column] for column in columns) for row in df.collect())
    result = database.execute(ORACLE[name])
    names = [column[0] for column in result.description]
    assert sorted(names) == columns
    order = [names.index(column) for column in columns]
    assert found == Counter(tuple(row[i] for i in order) for row in result.fetchall())


def test_every_number_has_a_query():
    assert [name.split("_")[0] for name in QUERIES] == [f"op{n}" for n in range(1, 14)]
    assert set(ORACLE) <= set(QUERIES)


def test_suffix_dedup(spark, texts):
    found = QUERIES["op4_suffix_dedup"](spark, SF).collect()
    assert sorted(map(tuple, found)) == brute_bytes(texts.items(), 100)


def test_byte_bpe(spark, texts):
    ranks = read_ranks(None, public_tokenizers.path("byte_bpe_50k.tiktoken"))
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    for row in QUERIES["op7_byte_bpe"](spark, SF).collect():
        ids = plain.encode_ordinary(texts[row["doc_id"]])
        assert row["n_tokens"] == len(ids)
        assert row["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256(texts[row["doc_id"]].encode()).hexdigest()


def test_pipeline_stages(spark, database):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        after_df = stage(spark, docs, SF).cache()
        rows = after_df.collect()
        ids = {r["doc_id"] for r in rows}
        assert len(ids) == len(rows) and ids <= set(before)
        if name == "minhash_dedup":
            want = brute_components(before.items(), 5)
            assert ids == {i for i, (_, root) in want.items() if root == i}
        elif name == "decontamination":
            held = database.execute(f"SELECT doc_id FROM ({ORACLE['op6_decontamination']}) WHERE kept").fetchall()
            assert ids == set(before) & {i for (i,) in held}
        elif name == "secret_scans":
            assert ids == set(before)
        elif name == "byte_bpe":
            assert ids == set(before) and all(r["decodes"] for r in rows)
            break
        assert after_df.columns == columns
        docs, before = after_df, {r["doc_id"]: r["text"] for r in rows}


def test_pipeline_keeps_the_good_documents(spark):
    """On the next larger tables: the smallest have 87 labels, too few to learn from and to count on."""
    large = SF.replace("0.001", "0.01")
    docs = spark.read.parquet(f"{large}/documents.parquet")
    ids = {r["doc_id"] for r in corpus_pipeline.quality_classifier(spark, docs, large).select("doc_id").collect()}
    known = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{large}/labels.parquet").collect()}
    assert len(known) > 300 and sum((known[i] == 1) == (i in ids) for i in known) / len(known) > 0.95


def test_pipeline_runs(spark):
    assert corpus_pipeline.ORACLE_SQL is None
    found = corpus_pipeline.run(spark, SF).collect()
    assert found and all(r["decodes"] for r in found)


def test_pipeline_stages_on_edges(spark, edge_docs):
    """Null ids and texts, repeated rows, columns with names of the stages' own; and no rows at all."""
    clashing = edge_docs.selectExpr(
        "*", "'k' AS row_key", "'m' AS secret_spans", "7 AS gone_id", "'t' AS trusted_id", "'q' AS label", "1.5 AS bands"
    )
    own = {name: value for name, value in clashing.first().asDict().items() if name not in ("doc_id", "text", "lang", "source", "n_chars")}
    for name, stage in corpus_pipeline.STAGES:
        rows = stage(spark, clashing, SF).collect()
        nothing = stage(spark, clashing.limit(0), SF)
        assert nothing.collect() == []
        if name == "byte_bpe":
            assert len(rows) == clashing.count() and all(r["decodes"] for r in rows)
            break
        assert nothing.columns == clashing.columns
        for row in rows:
            assert {key: row[key] for key in own} == own
        ids = [r["doc_id"] for r in rows]
        if name == "minhash_dedup":
            # The three rows with one text are two documents, of which the smaller id stays.
            assert sorted(i for i in ids if i) == [1, 2, 3, 4, 5, 6, 9] and None in ids
        elif name != "quality_classifier":
            assert len(ids) == clashing.count()
