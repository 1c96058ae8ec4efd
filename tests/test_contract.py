"""Driver contract: entry() runs; every registered query equals its DuckDB twin on sf0.001."""

import os
import sys

import duckdb
import pytest

import __spark_entry__ as E
from conftest import SF
from tracefold.catalog import QUERIES

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))
from oracle_check import TABLES, digest  # noqa: E402


@pytest.fixture(scope="module")
def twin():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        if os.path.exists(f"{SF}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def test_entry(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "variant" in df.columns


def test_every_query_has_a_twin_or_is_listed():
    own, o = set(QUERIES), E.oracle_sql()
    assert own <= set(E.queries())
    assert own - set(o) == E.ROWS_ONLY_QUERIES & own


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_twin(spark, twin, name):
    df = E.queries()[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    assert len(set(df.columns)) == len(df.columns)
    if name in E.ROWS_ONLY_QUERIES:
        assert rows
        return
    cur = twin.execute(E.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    want = cur.fetchall()
    assert sorted(cols) == sorted(df.columns) and len(rows) == len(want)
    assert digest(rows, df.columns)[0] == digest(want, cols)[0]
