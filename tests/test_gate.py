"""Duplicate stop and rejection lists of the gate."""

import pytest

from placeloom.operators import gate


def test_duplicates_end_the_run(spark):
    ddl = "id string, name string, category string, address string"
    rows = [("b", "A·馆（1）", "x", "人民路1号"), ("a", "a馆（1）", "x", "人民路1号"), ("c", "a馆（1）", "y", "人民路1号"), ("d", "a馆（1）", "x", "人民路2号"), ("e", "a 馆（1）", "x", "人民路1号")]
    df = spark.createDataFrame(rows, ddl)
    assert sorted((r.id, r.original_id) for r in gate.approved_duplicates(df).collect()) == [("b", "a"), ("e", "a")]
    with pytest.raises(ValueError, match="2 approved records"):
        gate.assert_no_exact_duplicates(df)
    gate.assert_no_exact_duplicates(df.where("id in ('a', 'c', 'd')"))
    gate.assert_no_exact_duplicates(df.limit(0))


def test_rejections(spark):
    photos = [("p1", f"f{i}", 9 - i) for i in range(5)] + [("p2", "g0", 0), ("p2", "g1", 0)] + [("p3", "h0", 4)]
    p = spark.createDataFrame(photos, "place_id string, photo_id string, sort_order int")
    listed = spark.createDataFrame([("f1", "b"), ("f1", "a"), ("f3", "c"), ("h0", "d"), ("none", "e")], "photo_id string, reason string")
    removed, renumbered, missing = gate.apply_rejections(p, listed)
    assert sorted((r.photo_id, r.reason) for r in removed.collect()) == [("f1", "a"), ("f3", "c"), ("h0", "d")]
    assert sorted((r.new_order, r.photo_id) for r in renumbered.collect()) == [(0, "f4"), (1, "f2"), (2, "f0")]
    assert [tuple(r) for r in missing.collect()] == [("none", "e")]
