"""Queries with SQL against DuckDB."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from tripleweave.llm import queries, sql

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(row[i] for i in order) for row in data), key=repr)


def test_registered():
    assert set(queries.queries()) | {"pipeline"} <= set(entry.queries())
    assert set(sql.oracle_sql()) <= set(entry.oracle_sql())
    numbered = [n for n in queries.queries() if n != "quality_ablations"]
    assert [n.split("_")[0] for n in numbered] == [f"op{i}" for i in range(1, 14)]


@pytest.mark.parametrize("name", sorted(sql.oracle_sql()))
def test_query_matches_sql(spark, name):
    db = duckdb.connect()
    for table in "documents pages benchmark labels conversations".split():
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    found = queries.queries()[name](spark, SF_DIR)
    wanted = db.execute(sql.oracle_sql()[name])
    columns = [c[0] for c in wanted.description]
    assert rows(found.columns, found.collect()) == rows(columns, wanted.fetchall())
