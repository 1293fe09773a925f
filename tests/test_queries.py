"""Every query with SQL gives DuckDB's rows at the smallest scale."""

import duckdb
import pytest

from keyloom.plans import catalogue

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, name):
    df = catalogue.QUERIES[name](spark, DIR)
    got = sorted((tuple(map(str, r)) for r in df.select(*sorted(df.columns)).collect()))
    if name not in catalogue.ORACLE:
        assert got
        return
    want = duck.sql(catalogue.ORACLE[name])
    assert sorted(want.columns) == sorted(df.columns)
    at = [want.columns.index(c) for c in sorted(want.columns)]
    assert got == sorted(tuple(str(r[i]) for i in at) for r in want.fetchall())


@pytest.mark.parametrize("ids", [range(9), range(4), range(5, 9), range(0)])
def test_steps_of_the_log(spark, duck, tmp_path, ids):
    """Also where the number of events is a multiple of the steps', and where a step has none."""
    rows = [f"select cast({i} as bigint) event_id, now()::timestamp ts, cast({i % 3} as bigint) user_id, '{'error' if i in (5, 7) else 'view'}' event_type, 1.0::double as value, '' props" for i in ids]
    sql = " union all ".join(rows) or "select * from events limit 0"
    duck.execute(f"copy ({sql}) to '{tmp_path}/events.parquet' (format parquet)")
    got = catalogue.QUERIES["kv_read_while_writing"](spark, str(tmp_path)).select("step", "live").collect()
    want = duck.execute(f"with events as ({sql}) select * from ({catalogue.ORACLE['kv_read_while_writing']})").fetchall()
    assert sorted(map(tuple, got)) == sorted(want)
