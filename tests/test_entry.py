"""Every query with SQL against DuckDB on the smallest tables; the others give rows."""

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from skriva.plans.queries import QUERIES
from skriva.plans.sql import SQL

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no tables")


def normal(rows, columns):
    order = [columns.index(c) for c in sorted(columns)]
    show = lambda v: ("nan" if math.isnan(v) else f"{v:.9g}") if isinstance(v, float) else repr(v)
    return sorted(tuple(show(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    if name not in SQL:
        assert df.count() > 0
        return
    cursor = duck.execute(SQL[name])
    columns = [d[0] for d in cursor.description]
    assert normal([tuple(r) for r in df.collect()], df.columns) == normal(cursor.fetchall(), columns)
    assert sorted(columns) == sorted(df.columns)


def test_entry(spark):
    assert 0 < entry.entry(spark).count() <= 20
    assert set(SQL) <= set(entry.oracle_sql()) <= set(entry.queries())
