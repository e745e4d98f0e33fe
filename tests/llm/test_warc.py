import hashlib

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, In, IsNotNull

from placeloom.llm import warc
from placeloom.llm.common import scratch_path

BIG = "é<p>\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n" * 9
ROWS = [
    (5, "http://a/1", BIG, "x"), (3, "http://a/2", BIG, "y"), (9, None, BIG, "z"), (1, "http://b\r\nWARC-Type: x", "short", "x"), (2, "http://b", "short", None),
    (4, "u", None, None), (6, "u", "", None), (7, "http://ü", "y" * 300_000, None), (8, "u", "z" * 100, None), (8, "u", "z" * 100, None), (10, "u", "z" * 100, None),
    (None, "u", "n" * 120, None), (11, "u", "n" * 120, None)]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(ROWS, "page_id long, url string, html string, payload string")


def expected():
    out = []
    for i, _, h, _ in ROWS:
        b = (h or "").encode()
        ids = [j for j, _, g, _ in ROWS if (g or "") == (h or "") and j is not None]
        again = len(b) >= 100 and i != min(ids)
        out.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", min(ids) if again else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("compression", ["none", "gzip"])
def test_round_trip(spark, pages, compression):
    path = warc.archive_pages(pages.repartition(3), compression)
    got = warc.archive_digest(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted((tuple(r) for r in got), key=str) == expected()
    back = {r.record_id: bytes(r.payload) for r in warc.read(spark, path).where("record_type = 'response'").collect()}
    assert back["urn:page:3"] == BIG.encode() and back["urn:page:7"] == b"y" * 300_000 and back["urn:page:4"] == b""


def test_filters_reach_the_reader(spark, pages):
    path = warc.archive_pages(pages)
    df = warc.read(spark, path, "record_type string, record_id string").where((F.col("record_type") == "revisit") & F.col("record_id").isin("urn:page:5", "urn:page:1"))
    assert [r.record_id for r in df.collect()] == ["urn:page:5"]
    reader = warc.WarcReader(df.schema, {"path": path})
    rest = list(reader.pushFilters([EqualTo(("record_type",), "revisit"), In(("record_id",), ("a",)), IsNotNull(("refers_to",)), EqualTo(("date",), "x")]))
    assert rest == [EqualTo(("date",), "x")]
    assert "revisit" not in df._jdf.queryExecution().executedPlan().toString()  # no filter is left above the scan


def test_payloads_are_skipped(tmp_path):
    raw = warc.record("response", "a", "u", None, None, None, b"x" * 50) + warc.record("revisit", "b", None, None, "a", "d", None) + warc.record("response", "c", "u", None, None, None, b"last")
    (tmp_path / "f.warc").write_bytes(raw)
    with (tmp_path / "f.warc").open("rb") as f:
        got = list(warc.read_records(f, lambda h: h["warc-record-id"] != "<a>", True))
    assert [h["warc-record-id"] for h, _, _ in got] == ["<b>", "<c>"] and got[1][2] == b"last"
    with (tmp_path / "f.warc").open("rb") as f:
        assert [p for _, _, p in warc.read_records(f, lambda h: True, False)] == [None] * 3
    with (tmp_path / "f.warc").open("wb") as f:
        f.write(raw[:-20])
    with pytest.raises(EOFError), (tmp_path / "f.warc").open("rb") as f:
        list(warc.read_records(f, lambda h: True, True))


def test_partitions_follow_files(spark, pages):
    path = warc.archive_pages(pages.repartition(4))
    df = spark.read.format("warc").schema("record_id string").option("split_bytes", 1).load(path)
    assert df.rdd.getNumPartitions() == 4 and df.count() == len(ROWS)


def test_empty(spark, pages):
    path = warc.archive_pages(pages.limit(0))
    assert warc.archive_digest(spark, path).count() == 0 and warc.read(spark, path).count() == 0


def test_overwrite(spark, pages):
    path = "file://" + scratch_path(spark, "warc").removeprefix("file:").removeprefix("//")
    for n in (4, 2):
        warc.page_records(pages.where(f"page_id < {n}")).write.format("warc").mode("overwrite").save(path)
    assert warc.read(spark, path, "record_id string").count() == 1
