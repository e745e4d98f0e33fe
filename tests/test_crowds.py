"""Very many rows at one spot: results stay whole, and rows that cannot match do not meet."""

from placeloom.operators import matching

FIELDS = "id string, name string, category string, address string, latitude double, longitude double"


def test_contained_names_of_a_crowd(spark, monkeypatch):
    names = [f"{a}{i}\u53f7\u793e\u533a\u98df\u5802" for i in range(1, 121) for a in ("\u524d\u7a0b\u7b2c", "\u65b0\u95f8\u7b2c")]
    places = [(f"p{i:04}", n + ("\u603b\u9986" if i % 3 == 0 else ""), "\u98df\u5802", "", 31.0, 121.0 + (i % 2) * 0.0001) for i, n in enumerate(names)]
    cands = [(f"c{i:04}", n[2:] if i % 4 == 0 else n + ("\uff08\u4e00\u697c\uff09" if i % 4 == 1 else ""), "\u98df\u5802", "", 31.0, 121.0) for i, n in enumerate(names)]
    cands += [("c9998", "\u793e\u533a\u98df\u5802", "\u98df\u5802", "", 31.0, 121.0), ("c9999", names[0], "\u98df\u5802", "", 31.0, 121.5)]
    met, near_pairs = [], matching.near_pairs

    def counted(*args, **more):
        out = near_pairs(*args, **more)
        met.append(out.count())
        return out

    monkeypatch.setattr(matching, "near_pairs", counted)
    c = spark.createDataFrame(cands, FIELDS).withColumnRenamed("id", "cand_id")
    got = {r[0]: r[1] for r in matching.match_existing(c, spark.createDataFrame(places, FIELDS), "address_name_contained").collect()}

    plain = lambda n: n.split("\uff08")[0]
    want = {}
    for cid, cn, _, _, _, clon in cands:
        a = plain(cn)
        hits = [pid for pid, pn, _, _, _, plon in places
                if a == pn or (min(len(a), len(pn)) >= 6 and (a in pn or pn in a) and abs(clon - plon) < 0.001)]
        if hits:
            want[cid] = min(hits)
    assert got == want and "c9998" not in got
    assert sum(met) < len(cands) * len(places) / 4
