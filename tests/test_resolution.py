"""Resolving duplicates does not store the list of all pairs at one address."""

from placeloom.operators import duplicates as DUP
from placeloom.plans import jobs

PLACE = "id string, name string, category string, address string, latitude double, longitude double, hours string, description string, updated_at long"


def test_pairs_of_one_address_are_not_stored(spark, monkeypatch):
    n = 60  # under the crowd limit, so all may meet
    rows = [(f"p{i:03d}", f"前程社区图书馆{chr(0x4e00 + 7 * i)}", "图书馆", "上海市徐汇区人民路5号", 31.0 + i * 0.01, 121.0, "", "", i) for i in range(n)]
    photos = spark.createDataFrame([("f1", "p000", "u", 0)], "photo_id string, place_id string, url string, sort_order int")
    stored = []

    def watched(store):
        def run(df):
            out = store(df)
            stored.append(out.count())
            return out
        return run

    for module in (DUP, jobs):
        monkeypatch.setattr(module, "cut_lineage", watched(module.cut_lineage))
    got = jobs.resolve_duplicates(spark.createDataFrame(rows, PLACE), photos)
    assert max(stored) < n * 12 and got.removed.count() == n - 1
    assert got.edges.where("a < b").count() == n * (n - 1) // 2
