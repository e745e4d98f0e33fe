"""Nearest places without meeting all places of a neighbourhood, and inside boxes."""

import random

import pytest
from pyspark.sql import functions as F

from placeloom.functions import geo
from placeloom.operators import grid
from placeloom.plans import jobs

PLACES = "id string, latitude double, longitude double"


def crowd(seed, n):
    r = random.Random(seed)
    some = [(31 + r.uniform(-0.3, 0.3), 121 + r.uniform(-0.3, 0.3)) for _ in range(n // 2)]
    town = [(31.1 + r.uniform(-1e-3, 1e-3), 121.1 + r.uniform(-1e-3, 1e-3)) for _ in range(n // 4)]
    spot = [r.choice(some + [(0.0, 0.0), (10.0, 100.0)]) for _ in range(n // 4)]  # several places at one point
    return [(f"p{i:05d}", *p) for i, p in enumerate(some + town + spot)]


def test_nearest_among_crowds(spark):
    r = random.Random(1)
    p = spark.createDataFrame(crowd(2, 800) + [("gone", float("nan"), 1.0)], PLACES)
    origins = [(i, 31 + r.uniform(-0.4, 0.4), 121 + r.uniform(-0.4, 0.4)) for i in range(60)] + [(100, 0.0, -0.0), (101, 30.5, 100.0), (102, None, 1.0), (None, 31.0, 121.0)]
    o = spark.createDataFrame(origins, "origin int, latitude double, longitude double")
    q = p.where("id <> 'gone'").select("id", F.col("latitude").alias("y"), F.col("longitude").alias("x"))
    d = geo.haversine_m("latitude", "longitude", "y", "x").alias("d")
    want = o.where("latitude IS NOT NULL").crossJoin(q).groupBy("origin").agg(F.min(F.struct(d, "id")).alias("b"))
    want = {(x.origin, x.b.id, x.b.d) for x in want.collect()} | {(102, None, None)}
    got = grid.nearest(o, p).collect()
    assert len(got) == len(origins) and {(x.origin, x.place_id, x.distance) for x in got} == want


def test_nearest_without_places(spark):
    o = spark.createDataFrame([(1, 31.0, 121.0)], "origin int, latitude double, longitude double")
    assert [tuple(x)[3:] for x in grid.nearest(o, spark.createDataFrame([], PLACES)).collect()] == [(None, None)]


@pytest.mark.parametrize("room", [16, 0])  # 0: down to the smallest cells
def test_default_places_in_boxes(spark, monkeypatch, room):
    monkeypatch.setattr(grid, "ROOM", room)
    monkeypatch.setattr(grid, "FINEST", 16 if room == 0 else grid.FINEST)
    r = random.Random(3)
    rows = []
    for i in range(80):
        lat, lon, h, w = 31 + r.uniform(-0.4, 0.4), 121 + r.uniform(-0.4, 0.4), r.choice([1e-4, 0.01, 0.3]), r.choice([1e-4, 0.02, 0.3])
        rows.append((i, lat, lat + h, lon, lon + w))
    rows += [(90, 31.2, 31.0, 121.0, 121.2), (91, 0.0, 0.0, 0.0, 0.0), (92, -1.0, 0.0, 5.0, -1.0), (90, 31.3, 31.2, 121.0, 121.3)]
    v = spark.createDataFrame(rows, "vid int, south double, north double, west double, east double")
    p = spark.createDataFrame([(*x, "食堂", "一号食堂") for x in crowd(4, 400)], PLACES + ", category string, name string")
    q = p.select("id", F.col("latitude").alias("y"), F.col("longitude").alias("x"))
    b = v.select("vid", F.least("south", "north").alias("s"), F.greatest("south", "north").alias("n"), F.least("west", "east").alias("w"), F.greatest("west", "east").alias("e"))
    d = geo.haversine_m((F.col("s") + F.col("n")) / 2, (F.col("w") + F.col("e")) / 2, F.col("y"), F.col("x")).alias("d")
    out = ~(F.col("y").between(F.col("s"), F.col("n")) & F.col("x").between(F.col("w"), F.col("e")))
    want = {(x.vid, x.m.id, not x.m.out) for x in b.crossJoin(q).groupBy("vid").agg(F.min(F.struct(out.alias("out"), d, "id")).alias("m")).collect()}
    assert {tuple(x) for x in jobs.default_places(v, p, ["食堂"]).collect()} == want


def test_a_far_origin_looks_at_few_places(spark, monkeypatch):
    """All places lie 30 km off; the ring of 32 km met every one of them."""
    seen = []
    join = grid.skew_join

    def counted(big, other, *a, **k):
        out = join(big, other, *a, **k)
        if "pid" in big.columns:
            seen.append(out.count())
        return out

    monkeypatch.setattr(grid, "skew_join", counted)
    p = spark.range(20_000).selectExpr("concat('p', id) id", "31 + (id % 200) / 2000 latitude", "121 + floor(id / 200) / 2000 longitude")
    o = spark.createDataFrame([(1, 31.0, 120.7)], "origin int, latitude double, longitude double")
    assert grid.nearest(o, p).head().place_id and seen and max(seen) < 1000
