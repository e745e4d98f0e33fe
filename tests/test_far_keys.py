"""Queries on photos whose place keys pass 79 807, where the phash product leaves BIGINT."""

import duckdb
import pytest

from placeloom.catalog import CHECKS, QUERIES
from placeloom.sources.derived import BASE
from test_catalog import shown

SMALL = "/root/testdata/sf0.001"
SHIFT = 79_750  # of 150 customers, some stay below the edge and some pass it
NAMES = [
    "a2_under_quota", "a5_vision_records", "a7_csv_backup", "a8_publish_docs", "b20_image_candidates", "c2_nearby_pairs", "c9_mirror_diff",
    "c12_decision_carry_over", "d3_field_coverage", "d5_quota_violations", "d6_cross_place_content", "d8_canonical", "d9_survivorship",
    "d10_photo_reparenting", "d15_removal_reasons", "e12_gallery", "e13_close_hash_pairs", "e13_thin_near_copies", "e15_namespace_append",
    "e15_namespace_first", "e15_namespace_replace",
]


@pytest.fixture(scope="module")
def far(spark, tmp_path_factory):
    folder, duck = str(tmp_path_factory.mktemp("far")), duckdb.connect()
    duck.execute("SET TimeZone='UTC'")
    for t in BASE:
        key = {"customer": "c_custkey", "orders": "o_custkey"}.get(t)
        more = f"REPLACE ({key} + {SHIFT} AS {key})" if key else ""
        duck.execute(f"COPY (SELECT * {more} FROM '{SMALL}/{t}.parquet') TO '{folder}/{t}.parquet' (FORMAT parquet)")
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return folder, duck


@pytest.mark.parametrize("name", NAMES)
def test_far_keys(spark, far, name):
    folder, duck = far
    df = QUERIES[name](spark, folder)
    cols = sorted(df.columns)
    rows = sorted(tuple(shown(r[c]) for c in cols) for r in df.collect())
    if name not in CHECKS:
        return
    cur = duck.execute(CHECKS[name])
    at = [[d[0] for d in cur.description].index(c) for c in cols]
    assert rows == sorted(tuple(shown(r[i]) for i in at) for r in cur.fetchall())
