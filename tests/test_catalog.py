"""Every registered query against its check SQL on the smallest data set."""

import decimal
import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__ as entry
from placeloom.sources.derived import BASE

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in BASE:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


def shown(v):
    if isinstance(v, decimal.Decimal):
        v = int(v) if v == int(v) else float(v)
    return repr(round(v, 6) + 0.0) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, FOLDER)
    cols = sorted(df.columns)
    rows = Counter(tuple(shown(r[c]) for c in cols) for r in df.collect())
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return
    cur = duck.execute(sql)
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    assert rows == Counter(tuple(shown(r[i]) for i in at) for r in cur.fetchall())


def test_entry(spark):
    assert entry.entry(spark).columns
