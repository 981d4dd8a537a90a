"""Every registered query against its DuckDB oracle (as the driver checks it),
on the smallest tables; queries without SQL must at least run."""

import os
import sys

import duckdb
import pytest

from conftest import SF001

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))
from check_oracle import TABLES, digest  # noqa: E402

import __spark_entry__ as E  # noqa: E402


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", sorted(E.queries()))
def test_query(spark, con, name):
    df = E.queries()[name](spark, SF001)
    cols = df.columns
    rows = [tuple(r) for r in df.collect()]
    sql = E.oracle_sql().get(name)
    if sql is None:
        assert len(cols) > 0
        return
    res = con.sql(sql)
    assert sorted(cols) == sorted(res.columns)
    orows = res.fetchall()
    assert len(rows) == len(orows)
    assert digest(cols, rows) == digest(res.columns, orows)


def test_entry(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns == ["query_id", "rn", "doc_id", "rank"]
