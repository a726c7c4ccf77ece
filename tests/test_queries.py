"""Every query with SQL against DuckDB on the smallest tables."""

import datetime as dt
import os

import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for name in os.listdir(FOLDER):
        con.execute(f"CREATE VIEW {name.partition('.')[0]} AS SELECT * FROM '{FOLDER}/{name}'")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 4)
    return v.replace(tzinfo=None) if isinstance(v, dt.datetime) else v


NAMES = sorted(n for n in entry.oracle_sql() if not (entry.llm_queries and n in entry.llm_queries.QUERIES))


@pytest.mark.parametrize("name", NAMES)
def test_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, FOLDER)
    result = duck.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    want = [dict(zip(columns, r)) for r in result.fetchall()]
    got = [r.asDict() for r in df.collect()]
    assert sorted(df.columns) == sorted(columns)
    key = lambda rows: sorted((tuple(plain(r[c]) for c in sorted(columns)) for r in rows), key=repr)
    assert key(got) == key(want)


def test_entry_and_registry(spark):
    assert entry.entry(spark).columns[:2] == ["c_c_custkey", "c_c_name"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert {f"p{n}_found" for n in range(2, 8)} <= set(entry.queries())
