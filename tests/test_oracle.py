"""Every query with SQL gives the rows that DuckDB gives on the same tables."""

import datetime
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from velarium.plans import catalog

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
SQL = catalog.oracle_sql()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return plain(float(v)) if type(v).__name__ == "Decimal" else v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for n in os.listdir(DATA):
        p = f"{DATA}/{n}" + ("/*.parquet" if os.path.isdir(f"{DATA}/{n}") else "")
        c.execute(f"CREATE VIEW {n.split('.')[0]} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, duck, name):
    df = catalog.queries()[name](spark, DATA)
    q = duck.execute(SQL[name])
    names = [x[0] for x in q.description]
    assert sorted(names) == sorted(df.columns)
    ours = sorted(repr(tuple(plain(r[c]) for c in names)) for r in df.collect())
    theirs = sorted(repr(tuple(plain(x) for x in r)) for r in q.fetchall())
    assert ours == theirs


def test_entry_gives_rows(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_its_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
