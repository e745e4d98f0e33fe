"""Crowded cells dealt to several tasks, and reviewed partners that travel with their record."""

import pytest
from pyspark.sql import functions as F

from placeloom.functions import geo
from placeloom.operators import duplicates as DUP, grid
from placeloom.operators.scale import skew_join

POINTS = "id string, category string, latitude double, longitude double"


def crowd(spark):
    rows = [(f"p{i:03d}", "ab"[i % 2], 31.0, 121.0) for i in range(60)] + [(f"q{i:03d}", "a", 31.0 + i * 1e-4, 121.0) for i in range(30)]
    return spark.createDataFrame(rows, POINTS)


@pytest.mark.parametrize("hot", [None, 7])
def test_dealt_cells_give_the_same_pairs(spark, hot):
    df = crowd(spark)
    a, b = (df.select(*[F.col(c).alias(p + c) for c in df.columns]) for p in "ab")
    near = geo.haversine_m("alatitude", "alongitude", "blatitude", "blongitude") <= 60
    want = sorted((x.aid, x.bid) for x in a.join(b, (F.col("acategory") == F.col("bcategory")) & (F.col("aid") < F.col("bid"))).where(near).collect())
    got = grid.near_self_pairs(df, 60.0, ["category"], hot_rows=hot)
    assert sorted((x.a_id, x.b_id) for x in got.collect()) == want
    met = grid.near_pairs(df, df, 60.0, ["category"], hot_rows=hot).where("l_id < r_id")
    assert sorted((x.l_id, x.r_id) for x in met.collect()) == want


def test_a_hot_cell_is_several_keys(spark, monkeypatch):
    """Rows of one key that meet in a task, with and without dealing."""
    seen = []
    monkeypatch.setattr(grid, "skew_join", lambda big, other, keys, **k: seen.append(k) or skew_join(big, other, keys, **k))
    grid.near_self_pairs(crowd(spark), 60.0, ["category"], hot_rows=7).count()
    assert seen == [{"hot_rows": 7, "grown": True}]


def test_reviewed_pairs_do_not_meet_the_list(spark):
    """The list is joined with the records; no join or shuffle comes after the pairs were met."""
    rows = [(f"p{i}", f"名{i}", "a", "", 31.0, 121.0, "", "") for i in range(6)]
    places = spark.createDataFrame(rows, "id string, name string, category string, address string, latitude double, longitude double, hours string, description string")
    photos = spark.createDataFrame([], "place_id string")
    reviewed = [("p1", "p0", "seen"), ("p1", "p2", None), ("p3", "p4", "seen"), ("p3", "p4", "twice"), (None, "p5", "seen")]
    out = DUP.near_duplicate_audit(places, photos, spark.createDataFrame(reviewed, "first_id string, second_id string, reason string"))
    got = sorted((x.first_id, x.second_id, x.review_status) for x in out.collect() if x.review_status == "verified_distinct")
    assert got == [("p0", "p1", "verified_distinct")] + [("p3", "p4", "verified_distinct")] * 2
    assert out.count() == 16
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join Inner") == 1
    assert "Join Left" not in out._jdf.queryExecution().optimizedPlan().toString()
