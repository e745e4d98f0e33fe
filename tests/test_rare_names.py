"""Crowds of names that have most of their letters in common: rare parts meet, and the evidence stays that of all pairs."""

import random

from pyspark.sql import functions as F

from placeloom.functions import text as T
from placeloom.operators import duplicates as DUP, grid


def test_rare_keys_miss_nothing(spark):
    r = random.Random(11)
    names = ["a", "ab", "aa", "aaaa", "aaaaaaaaaa", "baaaabaaaa"]
    for _ in range(25):
        base = "".join(r.choice("abcdef") for _ in range(r.choice([3, 4, 5, 6, 9, 12, 17, 22, 23, 27, 28, 49, 56, 60])))
        for _ in range(6):
            v = list(base)
            for _ in range(r.randrange(0, 1 + len(base) // 5)):
                k = r.randrange(len(v) + 1)
                v[k:k + r.randrange(2)] = [r.choice("abcd")] * r.randrange(2)
            names.append("".join(v))
        names.append("x" + base + "yz")
    rows = [(f"n{i:03d}", "a", nm, 31.0 + i * 1e-7, 121.0) for i, nm in enumerate(names)]
    rows += [(f"m{i:03d}", "a", f"zzzzzz{i}", 31.0, 121.0) for i in range(4 * grid.CROWD)]
    df = spark.createDataFrame(rows, "id string, category string, nm string, latitude double, longitude double")
    a, b = F.col("a_nm"), F.col("b_nm")
    wanted = (T.similarity(a, b) >= 0.82) | ((F.least(F.length(a), F.length(b)) >= 4) & T.contains_either(a, b))
    plain = grid.near_self_pairs(df, 120.0, ["category"])
    keyed = grid.near_self_pairs(df, 120.0, ["category"], keyed_names=DUP.rare_name_keys)
    want = {(x.a_id, x.b_id) for x in plain.where(wanted).collect()}
    assert {(x.a_id, x.b_id) for x in keyed.where(wanted).collect()} == want and len(want) > 100
    assert keyed.count() == keyed.select("a_id", "b_id").distinct().count() < plain.count()


def test_common_parts_make_no_meetings(spark):
    """2 000 numbered names: under a twentieth of the pairs meet; by keys that do not follow what is rare, all do."""
    r = random.Random(5)
    rows = [(f"{i:04d}", "a", f"前程第{r.randrange(1_000_000):06d}社区图书馆", 31.0, 121.0) for i in range(2000)]
    df = spark.createDataFrame(rows, "id string, category string, nm string, latitude double, longitude double")
    met = grid.near_self_pairs(df, 120.0, ["category"], keyed_names=DUP.rare_name_keys, ids_only=True).count()
    old = grid.near_self_pairs(df, 120.0, ["category"], fine=DUP.similar_name_keys, ids_only=True).count()
    assert met < old / 20


def test_links_give_the_groups_of_all_edges(spark):
    r = random.Random(7)
    ddl = "id string, name string, category string, address string, latitude double, longitude double"
    rows = []
    for i in range(400):
        name = "".join(r.choice("甲乙丙丁戊己庚辛") for _ in range(r.randint(2, 6))) if i % 4 else f"前程第{i}社区图书馆"
        address = f"上海市黄浦区人民路{r.choice([1, 1, 1, 2, 12])}号" + r.choice(["", "", "二楼东侧"])
        rows.append((f"p{i:03d}", name, "图书馆", address, 31.0 + r.randrange(3) * 0.0005, 121.0))
    units, members = DUP.signatures(spark.createDataFrame(rows, ddl))
    edges = DUP.duplicate_edges(units).cache()
    pairs = units.select(*[F.col(c).alias("a_" + c) for c in units.columns if c != "category"], "category").join(
        units.select(*[F.col(c).alias("b_" + c) for c in units.columns if c != "category"]), F.col("a_id") < F.col("b_id"))
    want = {(x.a, x.b, x.rule) for x in DUP._evidence(pairs).collect()}
    assert {(x.a, x.b, x.rule) for x in edges.collect() if x.a != x.b} == want and len(want) > 100
    assert edges.count() == edges.select("a", "b").distinct().count()
    links = DUP.duplicate_links(units).cache()
    assert links.count() < edges.count()
    by_all, by_links = (sorted(map(tuple, DUP.duplicate_groups(units, members, e).collect())) for e in (edges, links))
    assert by_all == by_links and by_all
