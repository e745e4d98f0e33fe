"""Viewport samples by counts of id ranges, against a plain window over all places in view."""

import random

import pytest
from pyspark.sql import Window, functions as F

from placeloom.functions import geo
from placeloom.operators.grid import points_in_boxes
from placeloom.plans import jobs

VIEW = "vid int, south double, north double, west double, east double, top_ratio double, bottom_ratio double"


def tables(spark):
    r = random.Random(5)
    views = [(i, 31.0, 31.0 + r.choice([0.1, 0.3]), 121.0, 121.0 + r.choice([0.1, 0.3]), r.choice([0.0, 0.2]), 0.0) for i in range(40)]  # many equal boxes
    views += [(3, 31.0, 31.4, 121.0, 121.4, 0.0, 0.0), (7, 31.0, 31.1, 121.0, 121.1, 0.0, 0.0), (None, 31.0, 31.2, 121.0, 121.2, 0.0, 0.0), (50, None, 31.0, 121.0, 121.2, 0.0, 0.0)]
    places = [(f"p{r.randrange(10**6):06d}", "图书馆", "市民图书馆", 31 + r.random() / 2, 121 + r.random() / 2) for _ in range(400)]
    places += places[:20]  # the same record twice
    return spark.createDataFrame(views, VIEW), spark.createDataFrame(places, "id string, category string, name string, latitude double, longitude double")


@pytest.mark.parametrize("ranges, limit", [(7, 5), (512, 20), (512, 1000)])
def test_sample_is_that_of_a_plain_window(spark, monkeypatch, ranges, limit):
    monkeypatch.setattr(jobs, "ID_RANGES", ranges)
    views, places = tables(spark)
    s, n = geo.inset_box(F.col("south"), F.col("north"), F.col("top_ratio"), F.col("bottom_ratio"))
    seen = points_in_boxes(places.select("id", "latitude", "longitude"), views.select("vid", s.alias("south"), n.alias("north"), "west", "east"))
    p, m = F.row_number().over(Window.partitionBy("vid").orderBy("id")) - 1, F.count(F.lit(1)).over(Window.partitionBy("vid"))
    rows = seen.select("vid", "id", p.alias("p"), m.alias("m"))
    want = [(x.vid, x.id, x.m > limit) for x in rows.collect() if x.m <= limit or x.p in {i * x.m // limit for i in range(limit)}]
    got = [(x.vid, x.id, x.sampled) for x in jobs.viewport_query(views, places, ["图书馆"], limit).collect()]
    assert len(want) > 100 and sorted(got, key=str) == sorted(want, key=str)


def test_only_sampled_ranges_are_numbered(spark, monkeypatch):
    """A box over all 400 places with a sample of two: two ranges of one place, not 400 rows, come to the numbering."""
    from placeloom.operators.scale import keep_value

    left = []
    monkeypatch.setattr(jobs, "keep_value", lambda df, *a: left.append(keep_value(df, *a).count()) or keep_value(df, *a))
    views = spark.createDataFrame([(i, 30.0, 32.0, 120.0, 122.0, 0.0, 0.0) for i in range(9)], VIEW)
    assert jobs.viewport_query(views, tables(spark)[1], ["图书馆"], 2).count() == 18 and left == [2]
