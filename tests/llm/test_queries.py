"""Queries with SQL give DuckDB's rows at the smallest scale."""

import duckdb
import pytest

from keyloom.llm import queries

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels"):
        duck.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    df = queries.QUERIES[name](spark, DIR)
    want = duck.sql(queries.ORACLE_SQL[name])
    assert sorted(want.columns) == sorted(df.columns)
    at = [want.columns.index(c) for c in df.columns]
    assert sorted((str(tuple(r)) for r in df.collect())) == sorted(str(tuple(r[i] for i in at)) for r in want.fetchall())
