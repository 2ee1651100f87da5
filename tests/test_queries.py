"""Every registered query equals its SQL on the smallest data."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from fleetscope.catalog.registry import TABLES

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


def normal(v):
    if v is None or v is pd.NaT or (isinstance(v, float) and v != v):
        return "~"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float) and v == int(v):
        return str(int(v))
    if hasattr(v, "isoformat"):
        return pd.Timestamp(v).isoformat()
    if hasattr(v, "as_tuple"):
        return format(v.normalize(), "f")
    return str(v)


def table(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(normal(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query(spark, con, name):
    df = entry.queries()[name](spark, FOLDER)
    cur = con.execute(entry.oracle_sql()[name])
    cols = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(cols)
    assert table(df.columns, df.collect()) == table(cols, cur.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
