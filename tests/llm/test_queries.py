"""The queries over the smallest tables: against DuckDB where SQL can express them, and the pipeline against brute force."""

from collections import Counter

import duckdb
import pytest
from corpus import words
from test_decontaminate import brute as contaminated
from test_near_duplicates import brute as classes

import corpus_pipeline
from lanewise.llm.queries import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def oracle():
    connection = duckdb.connect()
    for name in "documents embeddings pages benchmark".split():
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return connection


@pytest.mark.parametrize("name", list(SQL))
def test_query(spark, oracle, name):
    df = QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    relation = oracle.sql(SQL[name])
    assert columns == sorted(relation.columns)
    assert Counter(map(tuple, df.select(*columns).collect())) == Counter(relation.select(*[f'"{c}"' for c in columns]).fetchall())


def test_queries_without_sql(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    found = QUERIES["op3_minhash_near_dedup"](spark, FOLDER).collect()
    assert sorted(map(tuple, found), key=str) == classes([tuple(r) for r in docs])
    shards = QUERIES["op10_sharding"](spark, FOLDER).collect()
    assert {r["doc_id"]: r["size"] for r in shards} == {r["doc_id"]: len(r["text"].encode()) + 8 for r in docs}
    pages = QUERIES["op4_html_extraction"](spark, FOLDER).collect()
    assert len(pages) == spark.read.parquet(f"{FOLDER}/pages.parquet").count()
    assert all(r["n_chars"] == len(r["text"]) > 0 for r in pages)


def test_pipeline(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    before = {r["doc_id"]: r for r in docs.collect()}
    left = []
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, FOLDER)
        if n < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns
        out.write.parquet(str(tmp_path / str(n)))
        docs = spark.read.parquet(str(tmp_path / str(n)))
        left.append({r["doc_id"] for r in docs.collect()})
        assert docs.count() == len(left[-1])
    rows = lambda ids: [(i, before[i]["text"]) for i in sorted(ids)]
    assert all(words(before[i]["text"]) == [] for i in before.keys() - left[0])
    assert left[1] == {c for _, c in classes(rows(left[0]))}
    assert left[2] == {r[0] for r in contaminated(rows(left[1]), items) if not r[5]}
    assert left[3] <= left[2] and len(left[3]) > 0.6 * len(left[2])
    assert left[4] == left[3]
    assert {(r["shard"], r["slot"]) for r in corpus_pipeline.run(spark, FOLDER).collect()} == {(r["shard"], r["slot"]) for r in docs.collect()}


def test_pipeline_with_odd_columns(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").limit(50).selectExpr("*", "1 as copies", "'x' as rejected", "2 as contaminated", "3 as row", "4 as id")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, FOLDER).columns == docs.columns
        assert stage(spark, docs.limit(0), FOLDER).count() == 0


def test_stores(spark, monkeypatch):
    """On a cluster the shared folder has to be named; written tables can be deleted, other files can't."""
    from lanewise.llm import _store

    assert _store._one_process("local[4]") and _store._one_process("local") and not _store._one_process("local-cluster[2,1,1024]") and not _store._one_process("yarn")
    table = _store.pinned(spark.range(5))
    kept = spark.read.parquet(f"{FOLDER}/documents.parquet")
    n = kept.count()
    _store.removed(table, kept)
    assert spark.read.parquet(f"{FOLDER}/documents.parquet").count() == n
    import pytest

    with pytest.raises(Exception, match="(?i)file|path"):
        table.collect()
    monkeypatch.setattr(_store, "MOST_BROADCAST", 2)
    assert _store.near(spark.range(5)).count() == 5
