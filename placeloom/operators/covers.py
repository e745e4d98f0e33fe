"""Greatest version among the boxes over a point, by a quadtree over the boxes.

A box is cut into the largest quadtree cells inside it, and a cell keeps the greatest version that holds it whole, so a
stack of boxes over a cell is one number. Points meet single boxes only in the smallest cells, where a border runs, and
only boxes newer than what holds the whole cell. Near the outer borders of a stack no box holds a whole cell; there a
point meets the borders through its cell, of 1/16 to 1/32 of a box's width.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from placeloom.functions import geo
from placeloom.operators.grid import box_level, ordered_boxes
from placeloom.operators.scale import skew_join
from placeloom.session import cut_lineage

CORNERS = ["south", "north", "west", "east"]
DEPTH = 4  # levels a box is cut below the level of its own size


def _width(level: Column) -> Column:
    return F.lit(360.0) / F.pow(F.lit(2.0), level)


def _run(a: Column, b: Column) -> Column:
    """Whole numbers a..b, none if b < a."""
    return F.when(a <= b, F.sequence(a, b)).otherwise(F.array().cast("array<bigint>"))


def _inside(lo: Column, hi: Column, width: Column) -> tuple[Column, Column]:
    """First and last cell wholly between lo and hi; a cell as close to an edge as rounding may reach counts as cut by it."""
    slack = F.lit(1e-6)
    return F.ceil(lo / width + slack).cast("long"), F.floor(hi / width - slack).cast("long") - 1


def cut_boxes(boxes: DataFrame, named: list[str]) -> tuple[DataFrame, DataFrame]:
    """(whole, edges) of boxes(south, north, west, east, lv, *named).

    whole(lv, y, x, *named): the largest cells inside each box. edges(lv, y, x, corners, *named): the cells that a border
    crosses, DEPTH levels below the box's own level.
    """
    per = boxes.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(DEPTH)))).withColumn("own", F.col("lv") + F.col("j"))
    w, up = _width(F.col("own")), _width(F.col("own") - 1)
    names = {"y": ("south", "north"), "x": ("west", "east")}
    for n, (lo, hi) in names.items():
        a, b = _inside(F.col(lo), F.col(hi), w)
        pa, pb = _inside(F.col(lo), F.col(hi), up)
        first = F.col("j") == 0  # no cell above is taken then
        per = per.withColumns({n + "0": a, n + "1": b, n + "2": F.when(first, 0).otherwise(2 * pa), n + "3": F.when(first, -1).otherwise(2 * pb + 1)})
    rows = per.withColumn("y", F.explode(_run(F.col("y0"), F.col("y1"))))
    parents = (F.col("y2") <= F.col("y3")) & (F.col("x2") <= F.col("x3"))
    taken = parents & F.col("y").between(F.col("y2"), F.col("y3"))  # the middle of this row belongs to larger cells
    xs = F.when(taken, F.concat(_run(F.col("x0"), F.col("x2") - 1), _run(F.col("x3") + 1, F.col("x1")))).otherwise(_run(F.col("x0"), F.col("x1")))
    whole = rows.select(F.col("own").alias("lv"), "y", F.explode(xs).alias("x"), *named)
    leaf = per.where(F.col("j") == DEPTH)
    for n, (lo, hi) in names.items():
        leaf = leaf.withColumns({n + "4": F.floor(F.col(lo) / w).cast("long"), n + "5": F.floor(F.col(hi) / w).cast("long")})
    rows = leaf.withColumn("y", F.explode(_run(F.col("y4"), F.col("y5"))))
    middle = F.col("y").between(F.col("y0"), F.col("y1")) & (F.col("x0") <= F.col("x1"))
    xs = F.when(middle, F.concat(_run(F.col("x4"), F.col("x0") - 1), _run(F.col("x1") + 1, F.col("x5")))).otherwise(_run(F.col("x4"), F.col("x5")))
    edges = rows.select(F.col("own").alias("lv"), "y", F.explode(xs).alias("x"), *CORNERS, *named)
    return whole, edges


def _above(cells: DataFrame, level: Column | int, levels: list[int]) -> DataFrame:
    """cells(y, x) at `level`, once for each of the levels at or above it, with that level's cell (lv, cy, cx)."""
    at = F.lit(level) if isinstance(level, int) else level
    out = cells.withColumn("_to", F.explode(F.filter(F.array(*[F.lit(v) for v in levels]), lambda v: v <= at)))
    shift = (at - F.col("_to")).cast("int")
    out = out.withColumns({"_cy": F.call_function("shiftright", F.col("y"), shift), "_cx": F.call_function("shiftright", F.col("x"), shift)})
    return out


def levelled(boxes: DataFrame) -> tuple[DataFrame, list[int], list[int]]:
    """Stored boxes with the level `lv` of their size, all levels of their cells, and those of their edge cells."""
    boxes = cut_lineage(boxes.withColumn("lv", box_level(*[F.col(c) for c in CORNERS])))
    own = sorted(r[0] for r in boxes.select("lv").distinct().collect()) or [0]  # at most 21 numbers
    return boxes, sorted({v + j for v in own for j in range(DEPTH + 1)}), [v + DEPTH for v in own]


def covers(points: DataFrame, boxes: DataFrame, on: list[str] = ()) -> tuple[DataFrame, DataFrame]:
    """(points, edges): points gain `cell` and `cover`, the greatest version whose box holds the point's whole cell;
    edges(*on, cell, south, north, west, east, version) are the boxes to test point by point, those newer than the cell's cover only.

    boxes(south, north, west, east, version), corners in any order, edges included. A point without a finite
    position has no cell. Of equal boxes the newest is taken. Points meet only boxes that agree in the columns `on`.
    """
    on = list(on)
    boxes = ordered_boxes(boxes).groupBy(*on, "south", "north", "west", "east").agg(F.max("version").alias("version"))
    boxes, levels, leaves = levelled(boxes)
    finest = max(leaves)
    whole, edges = cut_boxes(boxes, [*on, "version"])
    whole = cut_lineage(whole.groupBy(*on, "lv", "y", "x").agg(F.max("version").alias("version")))
    over = whole.select(*on, F.col("lv").alias("_to"), F.col("y").alias("_cy"), F.col("x").alias("_cx"), F.col("version").alias("cover"))

    # an edge that a newer box covers in the whole cell says nothing there
    crossed, own = edges.select(*on, "lv", "y", "x").distinct(), [*on, "lv", "y", "x"]
    hidden = skew_join(_above(crossed, F.col("lv"), levels), over, [*on, "_to", "_cy", "_cx"], grown=True).groupBy(*own).agg(F.max("cover").alias("cover"))
    edges = skew_join(edges, hidden, own, "left", grown=True).where("cover IS NULL OR version > cover")
    edges = cut_lineage(edges.select(*on, F.col("lv").alias("_to"), F.col("y").alias("_cy"), F.col("x").alias("_cx"), "south", "north", "west", "east", "version"))

    at = lambda c: F.floor(F.col(c) / F.lit(360.0 / 2**finest)).cast("long")
    cell = F.when(geo.finite("latitude", "longitude"), F.struct(at("latitude").alias("y"), at("longitude").alias("x")))
    points = points.withColumn("cell", cell)
    cells = cut_lineage(points.where("cell IS NOT NULL").select(*on, "cell.*").distinct())
    best = skew_join(_above(cells, finest, levels), over, [*on, "_to", "_cy", "_cx"], grown=True).groupBy(*on, "y", "x").agg(F.max("cover").alias("cover"))
    tested = skew_join(_above(cells, finest, sorted(set(leaves))), edges, [*on, "_to", "_cy", "_cx"], grown=True)
    tested = skew_join(tested, best, [*on, "y", "x"], "left", grown=True).where("cover IS NULL OR version > cover")
    key = F.struct("y", "x").alias("cell")
    tested = tested.select(*on, key, "south", "north", "west", "east", "version")
    return skew_join(points, best.select(*on, key, "cover"), [*on, "cell"], "left"), tested


def newest_over(points: DataFrame, boxes: DataFrame, on: list[str] = ()) -> DataFrame:
    """(id, *on, version): the greatest version of the boxes, of those equal in `on`, over each of the points(id, *on, latitude,
    longitude); points without one go."""
    on = list(on)
    rows, edges = covers(points.select("id", *on, "latitude", "longitude"), boxes, on)
    rows = cut_lineage(rows)
    met = skew_join(rows, edges, [*on, "cell"]).where(
        F.col("latitude").between(F.col("south"), F.col("north")) & F.col("longitude").between(F.col("west"), F.col("east")))
    both = rows.select("id", *on, F.col("cover").alias("version")).unionByName(met.select("id", *on, "version"))
    return both.where("version IS NOT NULL").groupBy("id", *on).agg(F.max("version").alias("version"))


def wiped(written: DataFrame, wipes: DataFrame) -> DataFrame:
    """(id, seq) of the rows(id, seq, latitude, longitude) over which a box with a greater version lies.

    Rows meet boxes in the cells that a border crosses, and there only those newer than every box over the whole cell
    and than the row.
    """
    rows, edges = covers(written.select("id", "seq", "latitude", "longitude"), wipes)
    rows = cut_lineage(rows)
    sure = F.coalesce(F.col("cover") > F.col("seq"), F.lit(False))
    met = skew_join(rows.where(~sure), edges, ["cell"]).where(
        (F.col("version") > F.col("seq")) & F.col("latitude").between(F.col("south"), F.col("north")) & F.col("longitude").between(F.col("west"), F.col("east")))
    return rows.where(sure).select("id", "seq").unionByName(met.select("id", "seq")).distinct()
