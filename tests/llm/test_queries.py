"""Training-data queries that SQL can express, against that SQL."""

import os
from collections import Counter

import duckdb
import pytest

from placeloom.llm import queries

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


@pytest.mark.parametrize("name", sorted(queries.CHECKS))
def test_query_equals_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    shown = lambda v: repr(round(v, 9)) if isinstance(v, float) else str(v)
    got = Counter(tuple(shown(r[k]) for k in cols) for r in df.collect())
    cur = c.execute(queries.CHECKS[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    want = Counter(tuple(shown(r[names.index(k)]) for k in cols) for r in cur.fetchall())
    assert sum(want.values()) > 0 and got == want
