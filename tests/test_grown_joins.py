"""Rows that were multiplied for a join are never sent through the driver."""

from placeloom.operators.grid import near_pairs, near_self_pairs, points_in_boxes

POINTS = "id string, category string, latitude double, longitude double"


def joins(df):
    text = df._jdf.queryExecution().executedPlan().toString()
    return text.count("SortMergeJoin"), text.count("Broadcast")


def test_cells_are_not_broadcast(spark):
    rows = spark.createDataFrame([(f"p{i}", "x", 31 + i * 1e-4, 121.0) for i in range(9)], POINTS)
    pairs = near_pairs(rows, rows, 150.0, ["category"])
    assert joins(pairs) == (1, 0)
    assert pairs.where("l_id < r_id").count() == near_self_pairs(rows, 150.0, ["category"]).count() == 36
    assert joins(near_self_pairs(rows, 150.0, ["category"])) == (1, 0)


def test_boxes_are_not_broadcast(spark):
    points = spark.createDataFrame([("a", "x", 31.0, 121.0), ("b", "x", 40.0, 121.0)], POINTS)
    boxes = spark.createDataFrame([(1, 30.9, 31.1, 120.9, 121.1)], "vid long, south double, north double, west double, east double")
    met = points_in_boxes(points, boxes)
    assert joins(met) == (1, 0) and [r["id"] for r in met.collect()] == ["a"]
