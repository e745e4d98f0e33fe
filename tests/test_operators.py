"""Operators against plain sequential versions on small inputs, with hot keys forced."""

import math
import random

import pytest
from pyspark.sql import Window, functions as F

from placeloom.functions import geo, text as T
from placeloom.operators import duplicates as DUP, evidence as EV, gallery as G, graph, grid, ranking as R, scale, sync
from placeloom.operators.select import by_categories, by_category


def hav(a, b):
    la1, lo1, la2, lo2 = map(math.radians, (*a, *b))
    h = math.sin((la2 - la1) / 2) ** 2 + math.cos(la1) * math.cos(la2) * math.sin((lo2 - lo1) / 2) ** 2
    return 6371000 * 2 * math.atan2(math.sqrt(h), math.sqrt(1 - h))


@pytest.fixture()
def hot(monkeypatch):
    """Every key above five rows counts as hot."""
    monkeypatch.setattr(scale, "HOT_ROWS", 5)


def points(n, seed=1, spread=0.01):
    r = random.Random(seed)
    out = [(f"p{i:03d}", "ab"[r.random() < 0.3], 31 + r.random() * spread, 121 + r.random() * spread) for i in range(n)]
    return out + [(f"h{i:03d}", "a", 31.0051, 121.0052) for i in range(n // 3)]  # a third at one point


def test_near_self_pairs_equals_brute_force(spark, hot):
    rows = points(90)
    df = spark.createDataFrame(rows, "id string, category string, latitude double, longitude double")
    got = {(r.a_id, r.b_id) for r in grid.near_self_pairs(df, 120.0, ["category"]).collect()}
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[1] == b[1] and hav(a[2:], b[2:]) <= 120}
    assert got == want and len(want) > 400


@pytest.mark.parametrize("lat", [0.0, -33.0, 61.0])
def test_near_pairs_at_other_latitudes(spark, hot, lat):
    r = random.Random(3)
    left = [(f"l{i}", lat + r.uniform(-0.05, 0.05), 10 + r.uniform(-0.05, 0.05)) for i in range(60)]
    right = [(f"r{i}", lat + r.uniform(-0.05, 0.05), 10 + r.uniform(-0.05, 0.05)) for i in range(60)]
    ddl = "id string, latitude double, longitude double"
    got = {(x.l_id, x.r_id) for x in grid.near_pairs(spark.createDataFrame(left, ddl), spark.createDataFrame(right, ddl), 2000.0).collect()}
    assert got == {(a[0], b[0]) for a in left for b in right if hav(a[1:], b[1:]) <= 2000}


def test_nearest_equals_brute_force(spark):
    r = random.Random(5)
    places = [(f"p{i}", 31 + r.random(), 121 + r.random()) for i in range(40)]
    origins = [(i, 31 + r.random(), 121 + r.random()) for i in range(30)] + [(90, 39.9, 116.4), (91, -33.9, 18.4), (92, 0.0, 0.0), (93, 0.0, 0.0), (94, None, 1.0)]
    out = grid.nearest(spark.createDataFrame(origins, "origin_id int, latitude double, longitude double"), spark.createDataFrame(places, "id string, latitude double, longitude double"))
    got = {x.origin_id: x.place_id for x in out.collect()}
    for o in origins[:-1]:
        assert got[o[0]] == min(places, key=lambda p: (hav(o[1:], p[1:]), p[0]))[0]
    assert got[94] is None


def test_points_in_boxes(spark, hot):
    pts = points(60, 7, 2.0)
    boxes = [(i, 31 + i * 0.1, 31 + i * 0.1 + w, 121.0, 121.0 + w) for i, w in enumerate([0.001, 0.02, 0.3, 1.5, 2.0, 40.0, 0.0])] + [(9, 31.0051, 31.0051, 121.0052, 121.0052)]
    df = spark.createDataFrame(pts, "id string, category string, latitude double, longitude double")
    bx = spark.createDataFrame(boxes, "vid int, south double, north double, west double, east double")
    got = {(r.vid, r.id) for r in grid.points_in_boxes(df, bx).collect()}
    assert got == {(b[0], p[0]) for b in boxes for p in pts if b[1] <= p[2] <= b[2] and b[3] <= p[3] <= b[4]} and len(got) > 60


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_skew_join_equals_join(spark, how):
    big = spark.range(200).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 40).alias("k"), "id")
    other = spark.createDataFrame([(7, "a"), (7, "b"), (1, "c"), (99, "d")], "k long, v string")
    a = scale.skew_join(big, other, ["k"], how, hot_rows=10)
    b = big.join(other, "k", how)
    assert sorted(map(tuple, a.select(b.columns).collect()), key=str) == sorted(map(tuple, b.collect()), key=str)


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_rank_within_spread_equals_window(spark, keys):
    df = spark.range(300).select(F.when(F.col("id") % 3 == 0, "hot").otherwise((F.col("id") % 17).cast("string")).alias("k"), F.xxhash64("id").alias("v"), "id").repartition(5)
    got = scale.rank_within(df, keys, [F.desc("v")], "pos", hot_rows=20)
    w = Window.partitionBy(*keys).orderBy(F.desc("v"))
    want = df.withColumn("pos", F.row_number().over(w))
    assert {(r.id, r.pos) for r in got.collect()} == {(r.id, r.pos) for r in want.collect()}


def test_components_equal_union_find(spark, hot):
    r = random.Random(11)
    edges = [(r.randrange(120), r.randrange(120)) for _ in range(70)] + [(500 + i, 501 + i) for i in range(40)] + [(900, 900 + i) for i in range(1, 30)] + [(3000 - i, 3000) for i in range(1, 20)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    want = {n: find(n) for e in edges if e[0] != e[1] for n in e}
    got = {x.id: x.component for x in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == want


def test_keep_first_equals_sequential_scan(spark, hot):
    r = random.Random(13)
    n = 120
    clique = {i: (f"c{r.randrange(12)}" if r.random() < 0.5 else None) for i in range(n)}
    rank = {i: r.randrange(40) for i in range(n)}
    order = sorted(range(n), key=lambda i: (rank[i], i))
    place = {i: p for p, i in enumerate(order)}
    pairs = {tuple(sorted(r.sample(range(n), 2), key=place.get)) for _ in range(150)}
    kept = []
    for i in order:
        if not any((k, i) in pairs or (clique[k] is not None and clique[k] == clique[i]) for k in kept):
            kept.append(i)
    nodes = spark.createDataFrame([(i, rank[i], clique[i]) for i in range(n)], "id long, ord int, clique string")
    out = graph.keep_first(nodes, spark.createDataFrame(list(pairs), "earlier long, later long")).collect()
    assert {x.id for x in out if x.kept} == set(kept) and len(out) == n
    assert all(x.blocked_by in kept for x in out if not x.kept)


def test_thin_near_copies_equals_greedy(spark, hot):
    r = random.Random(17)
    base = [r.getrandbits(62) for _ in range(6)]
    rows = []
    for i in range(150):
        h = r.choice(base)
        for _ in range(r.randrange(0, 6)):
            h ^= 1 << r.randrange(62)
        rows.append((f"f{i:03d}", f"p{0 if i % 3 == 0 else r.randrange(4)}", h, r.randrange(9)))
    kept = {}
    for f, p, h, o in sorted(rows, key=lambda x: (x[3], x[0])):
        if not any(bin(h ^ g).count("1") <= 7 for g in kept.setdefault(p, {}).values()):
            kept[p][f] = h
    df = spark.createDataFrame(rows, "id string, place_id string, dhash long, o int")
    got = {x.id for x in G.thin_near_copies(df, F.col("o").cast("long")).collect() if x.kept}
    assert got == {f for k in kept.values() for f in k}


def gallery_rows():
    r = random.Random(19)
    rows = []
    for i in range(260):
        place = "p0" if i % 3 == 0 else f"p{r.randrange(1, 25)}"
        h = r.choice([3, 1 << 40, (1 << 20) - 1, r.getrandbits(62)])
        rows.append(dict(place_id=place, photo_id=f"f{i:03d}", score=round(r.uniform(-3, 12), 3), sort_order=r.randrange(8), close_person=r.random() < 0.1, blocked=r.random() < 0.1,
                         exterior=r.random() < 0.3, dhash=h, phash=r.getrandbits(62), vector=[r.uniform(-1, 1), r.uniform(-1, 1)], focus=r.choice("abc"), has_people=r.random() < 0.5))
    return rows


def test_gallery_equals_greedy_scan(spark, hot):
    rows = gallery_rows()
    want = {}
    by = {}
    for x in rows:
        by.setdefault(x["place_id"], []).append(x)

    def same(a, b):
        return (bin(a["dhash"] ^ b["dhash"]).count("1") <= 8 or bin(a["phash"] ^ b["phash"]).count("1") <= 10
                or sum(u * v for u, v in zip(a["vector"], b["vector"])) / 2 >= 0.94)

    for photos in by.values():
        photos.sort(key=lambda x: (-x["score"], x["sort_order"], x["photo_id"]))
        chosen = []
        for x in photos:
            if x["close_person"]:
                why = "close_person"
            elif x["blocked"]:
                why = "manual_or_cross_place_duplicate"
            elif len(chosen) >= 5:
                why = "over_limit"
            elif x["exterior"] and any(c["exterior"] for c in chosen):
                why = "extra_exterior"
            elif any(same(x, c) for c in chosen):
                why = "near_duplicate"
            elif sum(c["focus"] == x["focus"] for c in chosen) >= 2 and len(photos) > 5:
                why = "repeated_content"
            elif x["score"] < -1:
                why = "low_relevance_or_watermark"
            else:
                why = "kept"
                chosen.append(x)
            want[x["photo_id"]] = (why, None)
        chosen.sort(key=lambda x: (x["exterior"], not x["has_people"], -x["score"], x["photo_id"]))
        for i, x in enumerate(chosen):
            want[x["photo_id"]] = ("kept", i)
    ddl = ("place_id string, photo_id string, score double, sort_order int, close_person boolean, blocked boolean, exterior boolean, dhash long, phash long, "
           "vector array<double>, focus string, has_people boolean")
    df = spark.createDataFrame([tuple(x.values()) for x in rows], ddl)
    got = {x.photo_id: (x.reason, x.new_order) for x in G.pick_gallery(df).collect()}
    assert got == want and {w[0] for w in want.values()} >= {"kept", "over_limit", "near_duplicate", "repeated_content", "extra_exterior"}


@pytest.mark.parametrize("n,pins", [(500, [519]), (100, [3, 7, 400]), (519, []), (520, []), (7, list(range(10)))])
def test_even_sample(spark, n, pins):
    ids = [f"place-{i:03d}" for i in range(520)]
    pinned = [ids[p] for p in pins]
    fixed = [i for i in ids if i in pinned][:n]
    rest = [i for i in ids if i not in pinned]
    slots = n - len(fixed)
    want = sorted(set(fixed) | {rest[i * len(rest) // slots] for i in range(slots)}) if n < 520 else ids
    df = spark.createDataFrame([(i,) for i in ids], "id string")
    out = R.even_sample(df, n, ["id"], spark.createDataFrame([(p,) for p in pinned], "id string") if pinned else None)
    assert [r.id for r in out.orderBy("pos").collect()] == want


def test_even_sample_keeps_all_pinned(spark):
    df = spark.createDataFrame([(f"place-{i:03d}",) for i in range(100)], "id string")
    pinned = df.where("id < 'place-009'")
    assert [r.id for r in R.even_sample(df, 7, ["id"], pinned, all_pinned=True).orderBy("pos").collect()] == [f"place-{i:03d}" for i in range(9)]


def test_mentions_equal_brute_force(spark, hot):
    r = random.Random(23)
    word = lambda k: "".join(r.choice("abc") for _ in range(k))
    pages = [(i, word(r.randrange(3, 60))) for i in range(80)]
    aliases = [(f"p{i}", word(r.randrange(3, 7))) for i in range(40)]
    aliases += [(f"l{i}", pages[i][1][2:2 + 3 * i]) for i in range(2, 20)]  # of every size of run
    got = {(x.page_id, x.place_id) for x in EV.mentions(spark.createDataFrame(pages, "page_id int, key string"), spark.createDataFrame(aliases, "place_id string, alias string")).collect()}
    assert got == {(p[0], a[0]) for p in pages for a in aliases if len(a[1]) >= 4 and a[1] in p[1]} and got


def test_contained_addresses_miss_nothing(spark, hot):
    r = random.Random(29)
    base = ["".join(r.choice("甲乙丙丁") for _ in range(r.randrange(4, 14))) for _ in range(60)]
    base += [b + "二楼" for b in base[:20]] + ["前" + b for b in base[20:40]]
    rows = [("a" if i % 4 else "b", b) for i, b in enumerate(base)]
    got = {tuple(x) for x in DUP.contained_addresses(spark.createDataFrame(rows, "category string, addr string")).collect()}
    want = {(c, s, l) for c, s in set(rows) for d, l in set(rows) if c == d and s != l and len(s) >= 6 and s in l}
    assert got == want and want


def test_duplicate_copies_are_one_unit(spark, hot):
    """A third of all rows are copies of one record: they cost one edge, and all of them are grouped."""
    ddl = "id string, name string, category string, address string, latitude double, longitude double"
    rows = [(f"c{i:03d}", "某社区食堂", "食堂", "上海市黄浦区人民路1号", 31.2, 121.4) for i in range(100)]
    rows += [("x1", "某社区食堂二店", "食堂", "上海市黄浦区人民路1号", 31.2001, 121.4), ("y1", "别处图书馆", "图书馆", "上海市黄浦区人民路1号", 31.2, 121.4)]
    rows += [("u1", "", "自然", "", 0.0, 0.0), ("u2", "", "自然", "", 0.0, 0.0)]  # nothing known: no evidence
    units, members = DUP.signatures(spark.createDataFrame(rows, ddl))
    edges = DUP.duplicate_edges(units)
    assert sorted((e.a, e.b, e.a_copies) for e in edges.collect()) == [("c000", "c000", 100), ("c000", "x1", 100)]
    groups = DUP.duplicate_groups(units, members, edges).collect()
    assert len(groups) == 101 and {g.group_id for g in groups} == {"c000"}


def test_snapshot_merge(spark):
    ddl = "id string, latitude double, longitude double, name string"
    base = spark.createDataFrame([("stale", 31.2, 121.4, "old"), ("outside", 32.5, 121.4, "out")], ddl)
    box = (31.0, 32.0, 121.0, 122.0)

    def run(complete):
        snaps = spark.createDataFrame([(1, complete, *box)], "seq long, complete boolean, south double, north double, west double, east double")
        rows = spark.createDataFrame([("library", 31.3, 121.5, "new", 1)], ddl + ", seq long")
        return {r.id for r in sync.apply_snapshots(base, snaps, rows).collect()}

    assert run(False) == {"stale", "outside", "library"}
    assert run(True) == {"outside", "library"}


def test_guard_hash_ignores_order_and_partitions(spark):
    df = spark.range(500).select((F.col("id") % 3).alias("g"), F.col("id").cast("string").alias("v"))
    a = sorted(map(tuple, sync.guard_hash(df.repartition(7), ["g"], ["v"]).collect()))
    b = sorted(map(tuple, sync.guard_hash(df.orderBy(F.desc("v")).coalesce(1), ["g"], ["v"]).collect()))
    c = sorted(map(tuple, sync.guard_hash(df.withColumn("v", F.when(F.col("v") == "77", "x").otherwise(F.col("v"))), ["g"], ["v"]).collect()))
    assert a == b and a != c


def test_category_filters(spark):
    df = spark.createDataFrame([("a", "图书馆", "某图书馆"), ("b", "食堂", "某食堂"), ("c", "书店", "x"), ("d", "图书馆", "某书房")], "id string, category string, name string")
    ids = lambda x: sorted(r.id for r in x.collect())
    assert ids(by_category(df, "全部")) == ["a", "b"] and ids(by_category(df, "食堂")) == ["b"] and ids(by_category(df, "书店")) == []
    assert ids(by_categories(df, None)) == ["a", "b", "c", "d"] and ids(by_categories(df, [])) == [] and ids(by_categories(df, ["食堂", "书店"])) == ["b"]


def test_evidence_job(spark):
    from placeloom.plans.jobs import extract_evidence

    pages = [
        (1, "某街道图书馆\n地址：人民路1号二楼\n\n设有插座和饮水", True, "", ""),  # a source page: every line counts
        (2, "某街道图书馆位于人民路5号，设有插座\n别的话，设有厕所\n无关\n另有打印服务", False, "https://s.cn/?q=1", "https://s.cn/?q=1"),
        (3, "某街道图书馆设有插座", True, "https://s.cn/?q=1", "https://s.cn/?q=2"),  # answer of another request
        (4, "别处图书馆设有插座", True, "", ""),
    ]
    df = spark.createDataFrame(pages, "page_id int, text string, is_source boolean, requested_url string, result_url string")
    names = spark.createDataFrame([("p1", "某街道图书馆")], "id string, alias string")
    got = {(r.page_id, r.line_no, r.kind) for r in extract_evidence(df, names).collect()}
    # line 2 of page 1 has the same context text as line 1; lines 3 and 4 of page 2 do not name the place near by
    assert got == {(1, 1, "address"), (1, 1, "facility"), (1, 4, "facility"), (2, 1, "address"), (2, 1, "facility"), (2, 2, "address"), (2, 2, "facility")}


@pytest.mark.parametrize("seed", [1, 2])
def test_similar_names_in_a_crowded_spot(spark, hot, seed):
    """The finer key loses no pair that the name rules accept, and gives each once."""
    r = random.Random(seed)
    names = []
    for _ in range(12):
        base = "".join(r.choice("甲乙丙丁戊己") for _ in range(r.randrange(1, 19)))
        for _ in range(6):
            v = list(base)
            for _ in range(r.randrange(0, 4)):
                k = r.randrange(len(v) + 1)
                v[k:k + r.randrange(2)] = [r.choice("甲乙丙丁")] * r.randrange(2)
            names.append("".join(v))
        names.append("甲" + base + "乙丙")
    rows = [(f"n{i:03d}", "a", nm, 31.0 + i * 1e-7, 121.0) for i, nm in enumerate(names)]
    df = spark.createDataFrame(rows, "id string, category string, nm string, latitude double, longitude double")
    a, b = F.col("a_nm"), F.col("b_nm")
    inside = (F.least(F.length(a), F.length(b)) >= 4) & T.contains_either(a, b)
    wanted = (T.similarity(a, b) >= 0.82) | inside
    plain = grid.near_self_pairs(df, 120.0, ["category"])
    keyed = grid.near_self_pairs(df, 120.0, ["category"], fine=DUP.similar_name_keys)
    want = {(x.a_id, x.b_id) for x in plain.where(wanted).collect()}
    assert {(x.a_id, x.b_id) for x in keyed.where(wanted).collect()} == want and len(want) > 20
    assert keyed.select("a_id", "b_id").distinct().count() == keyed.count() < plain.count()
    nodes = df.unionByName(df.limit(1).withColumn("id", F.lit("empty")).withColumn("nm", F.lit(""))).withColumn("ord", F.length("nm"))
    free = DUP.grid_conflicts(nodes, ["category"], 55.0)
    got = {tuple(sorted((x.earlier, x.later))) for x in free.collect()}
    both = grid.near_self_pairs(nodes, 55.0, ["category"]).where(T.contains_either(a, b) & (F.col("distance") < 55))
    assert got == {(x.a_id, x.b_id) for x in both.collect()}


def test_publish_twice_pushes_nothing(spark):
    from placeloom.plans.jobs import publish

    ddl = "id string, name string, category string, address string, latitude double, longitude double, hours string, description string, updated_at long"
    places = spark.createDataFrame([(f"p{i}", f"n{i}", "自然", "a", 31.0, 121.0 + i, "", "", 1767225600) for i in range(5)], ddl)
    photos = spark.createDataFrame([("p1", f"f{i}", f"/u/{i}", i) for i in range(3)], "place_id string, photo_id string, url string, sort_order int")
    empty = spark.createDataFrame([], "id string, pushed_fingerprint string")
    actions, docs = publish(places, photos, empty)
    assert actions.count() == 5 and docs.where("id = 'p1'").first()["photos"] == ["/u/0", "/u/1", "/u/2"]
    mirror = sync.with_fingerprint(places, photos).select("id", F.col("fingerprint").alias("pushed_fingerprint"))
    assert publish(places, photos, mirror)[0].count() == 0
    swapped = photos.withColumn("sort_order", 2 - F.col("sort_order"))
    assert [(r.id, r.action) for r in publish(places, swapped, mirror)[0].collect()] == [("p1", "push_changed")]


def test_text_ngrams(spark):
    df = spark.createDataFrame([("abcd",), ("ab",), ("",)], "v string")
    assert [r.x for r in df.select(T.ngrams("v", 3).alias("x")).collect()] == [["abc", "bcd"], [], []]


def test_name_keys_grow_with_the_name_only(spark):
    df = spark.createDataFrame([(n, "".join(chr(0x4E00 + (i * 7919) % 2000) for i in range(n))) for n in (10, 20, 40, 80)], "n int, nm string")
    got = {r.n: r.k for r in df.select("n", F.size(DUP.similar_name_keys(0)).alias("k")).collect()}
    assert all(k <= 2 * n + 2 for n, k in got.items()), got


def test_free_slots_beyond_ten(spark):
    from placeloom.operators import ranking

    old = spark.createDataFrame([("a", "u0")], "place_id string, url string")
    new = spark.createDataFrame([("a", f"u{i}", i) for i in range(40)] + [("b", f"u{i}", i) for i in range(3)], "place_id string, url string, seq int")
    for quota in (20, F.lit(20)):
        got = ranking.append_to_free_slots(old, new, quota).groupBy("place_id").agg(F.count("*").alias("n"), F.max("sort_order").alias("m")).collect()
        assert {(r.place_id, r.n, r.m) for r in got} == {("a", 19, 19), ("b", 3, 2)}


def test_whole_texts_are_compared(spark):
    from placeloom.functions import text
    from placeloom.operators import evidence

    long = "字" * 900
    rows = spark.createDataFrame([("k", 1, long + "a"), ("k", 2, long + "b"), ("k", 3, long + "a")], "k string, n int, context string")
    assert [r.n for r in evidence.cap_evidence(rows, ["k"], ["n"], 9).orderBy("n").collect()] == [1, 2]
    assert evidence.cap_evidence(rows, ["k"], ["n"], 9, compared=800).count() == 1
    a = spark.createDataFrame([("", "上海市浦东新区" + "x" * 150_000,)], "m string, h string")
    assert len(a.select(text.nature_address(F.lit("上海市"), F.lit(""), "m", "h").alias("v")).first().v) >= 150_000


def test_photo_lists_of_any_length(spark):
    from placeloom.sources import files

    places = spark.createDataFrame([("a",), ("b",)], "id string")
    photos = spark.range(25).select(F.lit("a").alias("place_id"), F.format_string("p%02d", "id").alias("photo_id"), F.col("id").cast("string").alias("url"), F.lit(0).alias("sort_order"))
    got = {(r.id, r.part): r.photos for r in files.nest_photos(places, photos, 10).collect()}
    assert {k: len(v) for k, v in got.items()} == {("a", 0): 10, ("a", 1): 10, ("a", 2): 5, ("b", 0): 0}
    assert sum((got["a", i] for i in range(3)), []) == [str(i) for i in range(25)]


@pytest.mark.parametrize("radius", [60.0, 5000.0])
def test_grid_at_the_edges_of_the_map(spark, radius):
    """Pairs across ±180° and around the poles, against all pairs."""
    r, step = random.Random(8), radius / 111194.0
    pts = []
    for lat, lon in ((0, 180), (10, -180), (60, 179.9999), (89.9999, 10), (-89.9999, 30), (89.85, 0), (0, 0), (90, 0), (-90, 5)):
        for _ in range(12):
            pts.append((max(-90.0, min(90.0, lat + r.uniform(-2, 2) * step)), (lon + r.uniform(-2, 2) * step + 180) % 360 - 180))
    pts += [(89.9999, 190.0 - 360), (89.9999, 100.0), (0.0, 180.0), (0.0, -180.0)]
    df = spark.createDataFrame([(f"{i:03d}", "a", la, lo) for i, (la, lo) in enumerate(pts)], "id string, category string, latitude double, longitude double")
    a, b = (df.select(*[F.col(c).alias(p + c) for c in df.columns]) for p in "ab")
    d = geo.haversine_m("alatitude", "alongitude", "blatitude", "blongitude")
    want = {(x.aid, x.bid) for x in a.join(b, F.col("aid") < F.col("bid")).where(d <= radius).collect()}
    got = [(x.a_id, x.b_id) for x in grid.near_self_pairs(df, radius, ["category"]).collect()]
    assert len(want) > 100 and sorted(got) == sorted(want)
    met = [(x.l_id, x.r_id) for x in grid.near_pairs(df, df, radius).where("l_id < r_id").collect()]
    assert sorted(met) == sorted(want)


def test_nearest_at_the_edges_of_the_map(spark):
    r = random.Random(9)
    places = [(f"{i:03d}", r.uniform(-90, 90), r.uniform(-180, 180)) for i in range(60)] + [("e", 0.0, 179.9999), ("p", 89.99, 10.0)]
    origins = [(i, r.uniform(-90, 90), r.uniform(-180, 180)) for i in range(40)] + [(90, -0.0, -179.9999), (91, 89.99, -170.0), (92, 0.0, 180.0), (93, -0.0, 0.0), (94, 0.0, -0.0)]
    p = spark.createDataFrame(places, "id string, latitude double, longitude double")
    o = spark.createDataFrame(origins, "origin int, latitude double, longitude double")
    j = o.crossJoin(p.select("id", F.col("latitude").alias("y"), F.col("longitude").alias("x")))
    want = {x.origin: x.b.id for x in j.groupBy("origin").agg(F.min(F.struct(geo.haversine_m("latitude", "longitude", "y", "x").alias("d"), "id")).alias("b")).collect()}
    assert {x.origin: x.place_id for x in grid.nearest(o, p).collect()} == want


def test_viewport_corners(spark):
    from placeloom.operators import select

    nan, inf = float("nan"), float("inf")
    places = spark.createDataFrame([("a", "自然", 31.5, 121.5), ("b", "自然", 40.0, 100.0)], "id string, category string, latitude double, longitude double")
    boxes = [(1, 31.0, 32.0, 121.0, 122.0), (2, 32.0, 31.0, 122.0, 121.0), (3, nan, 32.0, 121.0, 122.0), (4, 31.0, inf, 121.0, 122.0), (5, None, 32.0, 121.0, 122.0), (6, 41.0, 31.0, 99.0, 122.0)]
    v = spark.createDataFrame(boxes, "vid int, south double, north double, west double, east double").withColumn("category", F.lit(select.dims.ALL_CATEGORIES))
    got = sorted((r.vid, r.id) for r in select.viewport_pages(v, places, 10).collect())
    assert got == [(1, "a"), (2, "a"), (6, "a"), (6, "b")]


def test_names_at_one_address(spark):
    """5 000 names at one address: far fewer meetings than pairs, and no similar pair is lost."""
    r = random.Random(3)
    alphabet = [chr(0x4E00 + i) for i in range(3000)]
    names = ["".join(r.choice(alphabet) for _ in range(r.randint(4, 9))) for _ in range(5000)]
    u = spark.createDataFrame([(f"{i:04d}", "a", "x", n) for i, n in enumerate(names)], "id string, category string, addr string, nm string")
    keyed = u.join(DUP.shared_letter_keys(u), "nm").withColumn("key", F.explode("keys")).drop("keys")
    met = DUP._equal_key_pairs(keyed, ["addr", "key"]).dropDuplicates(["a_id", "b_id"])
    few = u.limit(300).withColumn("nm", F.when(F.col("id") % 3 == 0, F.col("nm")).otherwise(F.concat(F.lit("字字"), F.substring("nm", 1, 4))))
    a, b = (few.select(F.col("id").alias(p + "_id"), F.col("nm").alias(p + "_nm")) for p in "ab")
    want = {(x.a_id, x.b_id) for x in a.join(b, F.col("a_id") < F.col("b_id")).where(T.similarity(F.col("a_nm"), F.col("b_nm")) >= 0.25).collect()}
    k = few.join(DUP.shared_letter_keys(few), "nm").withColumn("key", F.explode("keys")).drop("keys")
    got = {(x.a_id, x.b_id) for x in DUP._equal_key_pairs(k, ["addr", "key"]).select("a_id", "b_id").distinct().collect()}
    assert want <= got
    assert met.count() < 12_500_000 / 20


def test_cap_evidence_by_digest(spark):
    """Rows that carry only the digest of their text are capped as those with the text."""
    texts = ["热水 A", "热水a", "。", "热水 b", "x" * 900 + "1", "x" * 900 + "2"]
    rows = spark.createDataFrame([(k, n, t) for k in "ab" for n, t in enumerate(texts)], "k string, n int, context string")
    slim = rows.select("k", "n", EV.text_digest(T.alnum_key("context")).alias("d"))
    got = {tuple(r) for r in EV.cap_evidence(slim, ["k"], ["n"], 3, digest="d").select("k", "n", "rank").collect()}
    assert got == {tuple(r) for r in EV.cap_evidence(rows, ["k"], ["n"], 3).select("k", "n", "rank").collect()}
    assert got == {(k, n, i) for k in "ab" for i, n in enumerate((0, 3, 4), 1)}
