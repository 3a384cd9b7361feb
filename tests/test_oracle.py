"""Every query with SQL against DuckDB on the smallest tables, as the driver compares them."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from loomwright.plans import catalog

SF = "/root/testdata/sf0.001"


def norm(v):
    if isinstance(v, float):
        return repr(round(v, 9) + 0.0)
    return repr(v)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", list(catalog.ORACLES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    got, cols = df.collect(), sorted(df.columns)
    cur = duck.execute(catalog.ORACLES[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    want = cur.fetchall()
    rows = sorted(tuple(norm(r[c]) for c in cols) for r in got)
    assert rows == sorted(tuple(norm(r[names.index(c)]) for c in cols) for r in want)


@pytest.mark.parametrize("name", [n for n in catalog.QUERIES if n not in catalog.ORACLES])
def test_rows_only(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_entry_and_names(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(catalog.QUERIES) <= set(entry.queries())
    with pytest.raises(KeyError):
        catalog.query("chat_render")(lambda s, d: None)
