"""Derived tables on keys far beyond those of the smallest data set."""

import pytest

from placeloom.sources.derived import DERIVED, Tables, cte

M = 4611686018427387904


@pytest.fixture()
def far_keys(spark, tmp_path):
    rows = [(o, ck, "1-URGENT") for o, ck in enumerate([0, 1, 14_999, 79_699, 79_700, 89_999, 99_999, 5_399_999])]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    return str(tmp_path), rows


def test_photo_hashes_of_far_keys(spark, far_keys):
    folder, rows = far_keys
    got = {r["o"]: (r["dhash"], r["phash"]) for r in Tables(spark, folder)("photos_v").collect()}
    for o, ck, _ in rows:
        k = ck % 100000
        dhash = ((k * 7919 + (o % 3) * 104729) * 2654435761) % M + 2 ** (o % 40)
        phash = ((k * 104729 + (o % 5) * 7919) * 1103515245) % M + 2 ** (o % 37)
        assert got[o] == (dhash, phash)


def test_check_text_stays_narrow():
    assert "DECIMAL" not in cte("photos_v") and "DECIMAL" not in DERIVED["photos_v"]
