"""Newest box over a point, against every box."""

import math
import random

import pytest

from placeloom.operators import covers, sync


def inside(r, b):
    lat, lon = r
    corners = b[:4]
    if any(x is None or not math.isfinite(x) for x in (*corners, lat, lon)):
        return False
    return min(b[:2]) <= lat <= max(b[:2]) and min(b[2:4]) <= lon <= max(b[2:4])


def made(rng):
    boxes = [(lat, lat + rng.choice([0.0, 0.01, 0.3, 5, 40]) * rng.random(), lon, lon + rng.choice([0.0, 0.01, 0.3, 5, 90]) * rng.random())
             for lat, lon in ((rng.uniform(-80, 80), rng.uniform(-170, 170)) for _ in range(120))]
    boxes += [(b[1], b[0], b[3], b[2]) for b in boxes[:10]] + boxes[10:20]  # corners the other way round, equal boxes
    boxes += [(-90.0, 90.0, -180.0, 180.0), (22.5, 45.0, 0.0, 22.5), (22.5, 45.0, 22.5, 45.0), (math.nan, 1.0, 0.0, 1.0), (None, 1.0, 0.0, 1.0), (-math.inf, 1.0, 0.0, 1.0)]
    boxes = [(*b, i + 1) for i, b in enumerate(rng.sample(boxes, len(boxes)))]
    points = [(rng.uniform(-90, 90), rng.uniform(-180, 180)) for _ in range(200)]
    for b in boxes:
        if all(x is not None and math.isfinite(x) for x in b[:4]):
            lat, lon = rng.choice(b[:2]), rng.choice(b[2:4])  # a corner and what lies next to it
            points += [(lat, lon), (math.nextafter(lat, 99), lon), (lat, math.nextafter(lon, -999)), ((b[0] + b[1]) / 2, (b[2] + b[3]) / 2)]
    points += [(22.5, 22.5), (math.nextafter(22.5, 0), 22.5), (-0.0, 0.0), (90.0, 180.0), (-90.0, -180.0), (math.nan, 1.0), (None, 3.0)]
    return boxes, points


@pytest.mark.parametrize("seed", [1, 2])
def test_wiped_equals_every_box(spark, seed):
    rng = random.Random(seed)
    boxes, points = made(rng)
    rows = [(f"r{i}", rng.randint(0, len(boxes)), *p) for i, p in enumerate(points)]
    w = spark.createDataFrame(boxes, "south double, north double, west double, east double, version long")
    p = spark.createDataFrame(rows, "id string, seq long, latitude double, longitude double")
    got = {tuple(r) for r in covers.wiped(p, w).collect()}
    want = {(i, seq) for i, seq, *at in rows if any(b[4] > seq and inside(at, b) for b in boxes)}
    assert got == want and len(want) > 50


def test_cells_of_a_box_tile_it(spark):
    """The whole cells of one box do not overlap, and with the edge cells they cover it."""
    box = spark.createDataFrame([(30.61, 31.07, 120.13, 121.9, 1, 7)], "south double, north double, west double, east double, version long, lv int")
    whole, edges = (df.select("lv", "y", "x").collect() for df in covers.cut_boxes(box, ["version"]))
    leaf = 7 + covers.DEPTH
    fine = [(y, x) for lv, r, c in whole for y in range(r << leaf - lv, r + 1 << leaf - lv) for x in range(c << leaf - lv, c + 1 << leaf - lv)]
    cut = [(r.y, r.x) for r in edges]
    size = 360 / 2**leaf
    touched = {(y, x) for y in range(math.floor(30.61 / size), math.floor(31.07 / size) + 1) for x in range(math.floor(120.13 / size), math.floor(121.9 / size) + 1)}
    assert len(fine) == len(set(fine)) and len(cut) == len(set(cut)) and not set(fine) & set(cut) and set(fine) | set(cut) == touched


def test_deep_stacks_meet_few_rows(spark):
    """1 000 viewports over one town: rows meet the borders of those that no newer one hides, not all that cover them."""
    rng = random.Random(3)
    boxes = [(31 - rng.uniform(0.1, 0.5), 31 + rng.uniform(0.1, 0.5), 121 - rng.uniform(0.1, 0.5), 121 + rng.uniform(0.1, 0.5), i + 1) for i in range(1000)]
    rows = [(f"r{i}", rng.choice([0, 500, 990, 1000]), rng.uniform(30.4, 31.6), rng.uniform(120.4, 121.6)) for i in range(3000)]
    w = spark.createDataFrame(boxes, "south double, north double, west double, east double, version long")
    p = spark.createDataFrame(rows, "id string, seq long, latitude double, longitude double")
    got = {tuple(r) for r in covers.wiped(p, w).collect()}
    assert got == {(i, seq) for i, seq, *at in rows if any(b[4] > seq and inside(at, b) for b in boxes)}

    points, edges = covers.covers(p, w)
    assert points.join(edges, "cell").count() < sum(inside(at, b) for _, _, *at in rows for b in boxes) / 10


def test_replay_goes_on_from_an_earlier_replay(spark):
    rng = random.Random(8)
    at = [(rng.uniform(30, 32), rng.uniform(120, 122)) for _ in range(330)]  # places that stay where they are
    base = spark.createDataFrame([(f"p{i}", *at[i], f"n{i}") for i in range(300)], "id string, latitude double, longitude double, name string")
    snaps, rows = [], []
    for seq in range(1, 41):
        s, w = rng.uniform(30, 31.5), rng.uniform(120, 121.5)
        snaps.append((seq, seq % 3 > 0, s, s + rng.random(), w, w + rng.random()))
        rows += [(f"p{i}", *at[i], f"at{seq}", seq) for i in rng.sample(range(330), 5)]
    snaps = spark.createDataFrame(snaps, "seq long, complete boolean, south double, north double, west double, east double")
    rows = spark.createDataFrame(rows, base.schema.simpleString()[7:-1].replace(":", " ") + ", seq long")
    at_once = {tuple(r) for r in sync.apply_snapshots(base, snaps, rows).select("id", "name", "seq").collect()}
    half = sync.apply_snapshots(base, snaps.where("seq <= 20"), rows.where("seq <= 20"))
    later = sync.apply_snapshots(half, snaps.where("seq > 20"), rows.where("seq > 20"))
    assert {tuple(r) for r in later.select("id", "name", "seq").collect()} == at_once and at_once
    moved = spark.createDataFrame([("p0", 60.0, 60.0, "away", 1)], rows.schema)
    wipe = spark.createDataFrame([(2, True, 59.0, 61.0, 59.0, 61.0)], snaps.schema)
    assert {r.name for r in sync.apply_snapshots(base.where("id = 'p0'"), wipe, moved).collect()} == {"n0"}  # the older write elsewhere comes back


def test_viewport_pages_equal_sorted_lists(spark):
    """Small ids lie in a corner that most viewports just miss, so border cells are opened past their first places."""
    from placeloom.operators.select import viewport_pages

    rng = random.Random(12)
    places = [(f"a{i:04d}", rng.choice(["图书馆", "食堂"]), 31.5 + rng.uniform(0, 0.004), 121.5 + rng.uniform(0, 0.004)) for i in range(200)]
    places += [(f"b{i:04d}", rng.choice(["图书馆", "食堂", None]), rng.uniform(30, 32), rng.uniform(120, 122)) for i in range(800)]
    places += [("c1", "食堂", None, 121.0), ("c2", "食堂", math.nan, 121.0), ("c3", "自然", -90.0, -180.0), ("c4", "自然", 90.0, 180.0)]
    views = [(s, s + rng.uniform(0, 1), w, w + rng.uniform(0, 1)) for s, w in ((rng.uniform(30, 31.6), rng.uniform(120, 121.6)) for _ in range(40))]
    views += [(31.5 + rng.uniform(0, 0.004), 31.9, 121.5 + rng.uniform(0, 0.004), 121.9) for _ in range(20)]
    views += [(-90.0, 90.0, -180.0, 180.0), (90.0, -90.0, 180.0, -180.0), (31.0, 31.0, 121.0, 121.0), (math.nan, 32.0, 120.0, 122.0)]
    views = [(i, *v, rng.choice(["全部", "全部", "图书馆", "自然", "none"])) for i, v in enumerate(views)]
    p = spark.createDataFrame(places, "id string, category string, latitude double, longitude double")
    v = spark.createDataFrame(views, "vid int, south double, north double, west double, east double, category string")
    for limit in (1, 10, 5000):
        want = set()
        for vid, *box, cat in views:
            seen = sorted(i for i, c, *at in places if (cat == "全部" or c == cat) and inside(at, box))
            want |= {(vid, i, k + 1, len(seen) > limit) for k, i in enumerate(seen[:limit])}
        assert {tuple(r) for r in viewport_pages(v, p, limit).collect()} == want


def test_newest_over_is_the_greatest_version_of_all_boxes(spark):
    rnd = random.Random(5)
    boxes = []
    for v in range(1, 60):
        s, w = 30 + rnd.random(), 120 + rnd.random()
        boxes.append((s, s + rnd.random() / 2, w, w + rnd.random() / 2, v))
    points = [(f"p{i}", 30 + rnd.random() * 1.6, 120 + rnd.random() * 1.6) for i in range(400)]
    got = covers.newest_over(
        spark.createDataFrame(points, "id string, latitude double, longitude double"),
        spark.createDataFrame(boxes, "south double, north double, west double, east double, version long"))
    want = {}
    for i, y, x in points:
        over = [v for s, n, w, e, v in boxes if s <= y <= n and w <= x <= e]
        if over:
            want[i] = max(over)
    assert {r["id"]: r["version"] for r in got.collect()} == want
