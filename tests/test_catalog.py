"""All queries of the engine against DuckDB, over the smallest tables."""

import collections
import math

import duckdb
import pytest

from lanewise.plans.catalog import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def oracle():
    connection = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events".split():
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{FOLDER}/{name}.parquet'")
    return connection


def shown(rows):
    same = lambda x: "NaN" if isinstance(x, float) and math.isnan(x) else 0.0 if isinstance(x, float) and x == 0 else x
    return collections.Counter(tuple(map(same, r)) for r in rows)


def test_each_query_has_sql():
    assert QUERIES.keys() == SQL.keys()


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, oracle, name):
    df = QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    relation = oracle.sql(SQL[name])
    assert columns == sorted(relation.columns)
    expected = relation.select(*[f'"{c}"' for c in columns]).fetchall()
    assert shown(df.select(*columns).collect()) == shown(expected)
