"""Visit rows where several visitors share a six-digit code, and images whose pages share a url."""

import hashlib
import json

from placeloom.catalog import QUERIES
from placeloom.operators import visits as V
from placeloom.streaming import jobs


def shared_code():
    seen = {}
    for i in range(100_000):
        code = hashlib.sha256(f"app:u{i}".encode()).hexdigest()[:6]
        if code in seen:
            return seen[code], f"u{i}"
        seen[code] = f"u{i}"
    raise AssertionError("no two of them share a code")


def test_names_of_visitors_with_one_code(spark):
    a, b = shared_code()
    payload = json.dumps({"status": 0, "result": {"ad_info": {"province": "上海市", "city": "上海市", "district": "徐汇区"}}})
    events = spark.createDataFrame(
        [("v1", a, 31.0, 121.0, "5", "x", payload), ("v2", b, 31.0, 121.0, "5", "x", payload)],
        "id string, openid string, latitude double, longitude double, accuracy string, source string, payload string")
    for names in ([(a, "甲"), (b, "乙")], [(a, "甲")]):
        got = V.ingest(events, jobs.visitor_ids(spark.createDataFrame(names, "openid string, name string"), "app"), "app").collect()
        assert len({r.visitor_code for r in got}) == 1
        assert sorted((r.id, r.visitor_name) for r in got) == [("v1", "甲"), ("v2", dict(names).get(b, ""))]


def test_provenance_of_pages_with_one_url(spark, tmp_path):
    spark.createDataFrame([(i, f"https://a.example.com/{i // 8}") for i in range(16)], "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    spark.createDataFrame([(i,) for i in range(64)], "o_orderkey long").write.parquet(f"{tmp_path}/orders.parquet")
    got = sorted(tuple(r) for r in QUERIES["c11_provenance"](spark, str(tmp_path)).select("image_id", "verdict").collect())
    assert got == [(i, "selected" if i % 16 % 7 and i % 5 else "rejected") for i in range(64)]
