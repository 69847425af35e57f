"""Every query of the library against its SQL in DuckDB on the smallest tables."""

import os
from collections import Counter

import duckdb
import pytest

from pagewright.plans import ORACLES, QUERIES, books, contracts, corpus, detected, files, gates, outlines, reviewed  # noqa: F401

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in os.listdir(SF):
        con.execute(f"create view {f[:-8]} as select * from '{SF}/{f}'")
    return con


def value(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    rows = df.collect()
    assert len(set(df.columns)) == len(df.columns)
    if name not in ORACLES:
        return
    rel = duck.sql(ORACLES[name])
    assert sorted(rel.columns) == sorted(df.columns)
    at = [rel.columns.index(c) for c in df.columns]
    assert Counter(tuple(map(value, r)) for r in rows) == Counter(tuple(value(r[i]) for i in at) for r in rel.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
