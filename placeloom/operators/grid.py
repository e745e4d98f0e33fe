"""Distance and range joins on grid cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from placeloom.functions import geo
from placeloom.operators.scale import keep_value, skew_join
from placeloom.session import cut_lineage, drop_step


def _cells_around(df: DataFrame, lat: str, lon: str, radius: float, offsets) -> DataFrame:
    """One row per neighbour cell; the column number is taken at the width of the neighbour's own row and wraps at ±180°."""
    steps = F.explode(F.array(*[F.struct(F.lit(dr).alias("dr"), F.lit(dc).alias("dc")) for dr, dc in offsets]))
    rows = df.withColumn("_o", steps).withColumn("r", geo.grid_row(lat, radius) + F.col("_o.dr")).withColumn("_n", geo.grid_cols(F.col("r"), radius))
    rows = rows.where((F.col("_n") > 1) | (F.col("_o.dc") == 0))  # a row of one cell is its own neighbour
    rows = rows.withColumn("c", F.pmod(geo.grid_col(lon, F.col("r"), radius) + F.col("_o.dc"), F.col("_n")))
    return rows.withColumn("home", (F.col("_o.dr") == 0) & (F.col("_o.dc") == 0)).drop("_o", "_n")


def _own_cell(df: DataFrame, lat: str, lon: str, radius: float) -> DataFrame:
    return df.withColumn("r", geo.grid_row(lat, radius)).withColumn("c", geo.grid_col(lon, F.col("r"), radius))


def _prefixed(df: DataFrame, prefix: str, keep: list[str]) -> DataFrame:
    return df.select(*[F.col(c) if c in keep else F.col(c).alias(prefix + c) for c in df.columns])


CROWD = 64  # rows of a cell that may all meet
HOT_CELL = 500  # rows of a cell above which a list of all near pairs is made in several tasks
HALF = [(0, 0), (0, 1), (1, -1), (1, 0), (1, 1)]  # own cell and the four after it: every pair meets once


def near_self_pairs(
    df: DataFrame, radius: float, on: list[str], id_col: str = "id", lat: str = "latitude", lon: str = "longitude",
    unknown: str = "inf", fine=None, ids_only: bool = False, keyed_names=None, name: str = "nm", hot_rows: int | None = None,
) -> DataFrame:
    """Unordered pairs within `radius` metres and equal `on`; columns a_*, b_* with a_id < b_id, and distance.

    Every row is sent to its own cell and to the four cells after it, so a pair meets exactly once. Within a
    cell of the radius' size at least a fixed share of the pairs is near, so work follows the number of near pairs.

    A caller that wants only a part of the near pairs gives `fine(side)`, side 0 or 1: an array of text keys such
    that every wanted pair shares a key between its two sides. In cells of more than CROWD rows, rows, whose ids must differ
    then, meet on cell and key, so a crowded spot does not cost all its pairs; pairs that share no key may be missing
    there. In other cells a row meets at most CROWD others, and their keys are never made. No pair comes out twice.
    `keyed_names(names)` in its place makes such keys for all different values of the column `name` in crowded cells at once, as a
    table (name, side_0, side_1) of long keys, so that they can follow what is rare there; as a row has more of them, a cell
    is crowded from 4 · CROWD rows on.
    With ids_only the result is (*on, a_id, b_id). With `hot_rows`, the rows of a cell with more of them are dealt to several tasks:
    such a cell is a small part of the rows but has nearly all the pairs, which Spark's skew handling, going by bytes, does not see.
    """
    good = geo.finite(lat, lon)
    if unknown == "zero":
        good = good & (F.col(lat) != 0) & (F.col(lon) != 0)
    pts = df.where(good)
    cell = [*on, "r", "c"]
    keys_made = fine is not None or keyed_names is not None
    if not keys_made:
        probes, bases = _cells_around(pts, lat, lon, radius, HALF), _own_cell(pts, lat, lon, radius)
    else:
        # only ids and points meet, and the keys of a row are made once, before the row is sent to its cells; a clash of
        # their hashes only makes two rows meet
        slim = pts.select(*dict.fromkeys([*on, id_col, lat, lon]))
        crowds = _own_cell(slim, lat, lon, radius).groupBy(*cell).agg(F.count(F.lit(1)).alias("_n"))
        crowds = crowds.where(F.col("_n") > (CROWD if keyed_names is None else 4 * CROWD))
        crowds = cut_lineage(crowds.select(*cell, F.lit(True).alias("_full")))
        ends = [_cells_around(slim, lat, lon, radius, HALF), _own_cell(slim, lat, lon, radius)]
        if crowds.isEmpty():
            keyed = [rows.withColumn("_key", F.lit(0).cast("long")) for rows in ends]
        else:
            keyed, named = [], None
            if keyed_names is not None:
                probed = ends[0].join(crowds, cell, "left_semi").select(id_col).distinct()  # own cells are among the probed ones
                named = cut_lineage(keyed_names(pts.join(probed, id_col, "left_semi").select(name).distinct()))
            for side, rows in enumerate(ends):
                rows = rows.join(crowds, cell, "left")
                full = rows.where("_full").select(*cell, id_col, lat, lon, *[c for c in ("home",) if c in rows.columns]).join(pts.drop(*on, lat, lon), id_col)
                if named is None:
                    keys = F.array_distinct(F.transform(fine(side), lambda k: F.xxhash64(k)))
                else:
                    full, keys = full.join(named.select(name, F.col(f"side_{side}").alias("_keys")), name), F.col("_keys")
                light = rows.where("_full IS NULL").withColumn("_key", F.lit(0).cast("long")).drop("_full")
                keyed.append(light.unionByName(full.withColumn("_key", F.explode(keys)).select(*light.columns)))
        cell = [*cell, "_key"]
        probes, bases = keyed
    met = skew_join(_prefixed(probes, "x_", [*cell, "home"]), _prefixed(bases, "y_", cell), cell, hot_rows=hot_rows, grown=True)
    if keys_made:
        met = met.drop("_key")
    met = met.where(
        (~F.col("home") | (F.col(f"x_{id_col}") < F.col(f"y_{id_col}"))) & (F.col(f"x_{id_col}") != F.col(f"y_{id_col}"))
        & _same_band(f"x_{lat}", f"y_{lat}", radius))
    d = geo.haversine_m(f"x_{lat}", f"x_{lon}", f"y_{lat}", f"y_{lon}")
    met = keep_value(met.withColumn("_d", d), "distance", F.when(F.col("_d") <= radius, F.col("_d"))).drop("_d")
    if ids_only:
        a, b = F.least(f"x_{id_col}", f"y_{id_col}"), F.greatest(f"x_{id_col}", f"y_{id_col}")
        out = met.select(*on, a.alias(f"a_{id_col}"), b.alias(f"b_{id_col}"))
        return out.distinct() if keys_made else out
    if keys_made:  # the rows' other columns come back to the near pairs
        met = met.select(f"x_{id_col}", f"y_{id_col}", "distance").distinct()
        met = met.join(_prefixed(pts, "x_", on), f"x_{id_col}").join(_prefixed(pts, "y_", []).drop(*["y_" + c for c in on]), f"y_{id_col}")
    swap = F.col(f"x_{id_col}") > F.col(f"y_{id_col}")
    cols = [c for c in df.columns if c not in on]
    return met.select(
        *on, "distance",
        *[F.when(swap, F.col("y_" + c)).otherwise(F.col("x_" + c)).alias("a_" + c) for c in cols],
        *[F.when(swap, F.col("x_" + c)).otherwise(F.col("y_" + c)).alias("b_" + c) for c in cols],
    )


def near_pairs(
    left: DataFrame, right: DataFrame, radius: float, on: list[str] = (), lat: str = "latitude", lon: str = "longitude",
    hot_rows: int | None = None,
) -> DataFrame:
    """Left × right pairs within `radius` metres; left columns l_*, right columns r_*, and distance.

    With `hot_rows`, the right rows of a cell with more of them are dealt to several tasks, as in near_self_pairs.
    """
    on = list(on)
    offsets = [(dr, dc) for dr in (-1, 0, 1) for dc in (-1, 0, 1)]
    probe = _prefixed(_cells_around(left.where(geo.finite(lat, lon)), lat, lon, radius, offsets), "l_", [*on, "r", "c", "home"])
    base = _prefixed(_own_cell(right.where(geo.finite(lat, lon)), lat, lon, radius), "r_", [*on, "r", "c"])
    d = geo.haversine_m(f"l_{lat}", f"l_{lon}", f"r_{lat}", f"r_{lon}")
    met = skew_join(base, probe, [*on, "r", "c"], hot_rows=hot_rows, grown=True).where(_same_band(f"l_{lat}", f"r_{lat}", radius)).drop("r", "c", "home")
    return keep_value(met.withColumn("_d", d), "distance", F.when(F.col("_d") <= radius, F.col("_d"))).drop("_d")


def _same_band(a: str, b: str, radius: float) -> Column:
    """Cheap first test: the latitudes alone are not farther apart than the radius."""
    return F.abs(F.col(a) - F.col(b)) <= radius / geo.METERS_PER_DEGREE


FINEST = 22  # quadtree level of the search cells, about 9.5 m wide
FIRST_CELLS = 64  # cells that every origin looks at first
ROOM = 16  # places a cell may hold on average where places are met


def _cell_width(level: int) -> float:
    return 360.0 / 2**level


def _cells(points: DataFrame, level: int) -> DataFrame:
    """Occupied cells (y, x) of a level with their number of points n and one of these points, (rlat, rlon)."""
    up = F.lit(FINEST - level)
    at = [F.call_function("shiftright", F.col(c), up).alias(c) for c in ("y", "x")]
    one = [F.first(c).alias(n) for c, n in (("latitude", "rlat"), ("longitude", "rlon"))]  # of one row, as neither is NULL
    return points.groupBy(*at).agg(F.count(F.lit(1)).alias("n"), *one)


def _first_level(points: DataFrame) -> int:
    deepest = cut_lineage(_cells(points, 12).select("y", "x"))
    levels = [10, 8, 6, 4]
    up = lambda v: F.struct(*[F.call_function("shiftright", F.col(c), F.lit(12 - v)) for c in ("y", "x")])
    counts = deepest.agg(*[F.count_distinct(up(v)) for v in levels]).head()
    drop_step(deepest)
    return next((v for v, n in zip(levels, counts) if n <= FIRST_CELLS), 2)


def _within(lat: str, lon: str) -> Column:
    return F.col(lat).between(F.col("south"), F.col("north")) & F.col(lon).between(F.col("west"), F.col("east"))


def nearest(origins: DataFrame, places: DataFrame, place_id: str = "id", boxed: bool = False) -> DataFrame:
    """Origins with place_id and distance of the nearest place (ties: smaller id); NULL when there is none.

    With `boxed` only places inside an origin's own box count (south, north, west, east, in order, edges included).

    Distinct origins go down a quadtree of the distinct place points, two levels a round. Of the cells under its last ones an
    origin keeps those that may hold a place as near as the nearest one known so far, one point of each cell being known; so
    it looks at a few dozen cells a round, however many places there are and however far off they lie. Places are met when
    the cells that are left hold few of them.
    """
    keys = ["olat", "olon", *(["south", "north", "west", "east"] if boxed else [])]
    place = F.struct(F.col(place_id).alias("pid"))
    points = places.where(geo.finite("latitude", "longitude")).groupBy("latitude", "longitude").agg(F.min(place).alias("p"))
    at = [F.floor(F.col(c) / _cell_width(FINEST)).cast("long").alias(n) for c, n in (("latitude", "y"), ("longitude", "x"))]
    points = cut_lineage(points.select("latitude", "longitude", "p.pid", *at))
    # adding 0.0 turns -0.0 into 0.0, which distinct() takes for the same point
    there = {"olat": F.col("latitude") + 0.0, "olon": F.col("longitude") + 0.0}
    left = origins.where(geo.finite("latitude", "longitude")).withColumns(there).select(*keys).distinct()
    cores = max(left.sparkSession.sparkContext.defaultParallelism, int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    left = cut_lineage(left.repartition(cores))  # few bytes an origin, but many comparisons
    level = _first_level(points)
    looked = left.crossJoin(_cells(points, level)).withColumn("bound", F.lit(None).cast("double"))
    last = None
    while True:
        kept = cut_lineage(_still_open(looked, keys, level, boxed))
        drop_step(last)
        last = kept
        size, held = kept.agg(F.count(F.lit(1)), F.sum("n")).head()
        if not size or held <= ROOM * size or level == FINEST:
            break
        level += 2
        under = _cells(points, level).withColumns({"_y": F.call_function("shiftright", F.col("y"), F.lit(2)), "_x": F.call_function("shiftright", F.col("x"), F.lit(2))})
        up = kept.select(*keys, "bound", F.col("y").alias("_y"), F.col("x").alias("_x"))
        looked = skew_join(up, under, ["_y", "_x"]).drop("_y", "_x")
    lift = {c: F.call_function("shiftright", F.col(c), F.lit(FINEST - level)) for c in ("y", "x")}
    met = skew_join(points.withColumns(lift), kept.select(*keys, "bound", "y", "x"), ["y", "x"], grown=True)
    if boxed:
        met = met.where(_within("latitude", "longitude"))
    d = geo.haversine_m("olat", "olon", "latitude", "longitude")
    met = keep_value(met.withColumn("_d", d), "distance", F.when(F.col("bound").isNull() | (F.col("_d") <= F.col("bound")), F.col("_d")))
    best = met.groupBy(*keys).agg(F.min(F.struct("distance", "pid")).alias("_b"))
    found = cut_lineage(best.select(*keys, F.col("_b.pid").alias("place_id"), F.col("_b.distance").alias("distance")))
    for step in (kept, left, points):
        drop_step(step)
    return skew_join(origins.withColumns(there), found, keys, "left").select(*origins.columns, "place_id", "distance")


def _still_open(looked: DataFrame, keys: list[str], level: int, boxed: bool) -> DataFrame:
    """Cells in which an origin's nearest place may lie, with the distance `bound` of the nearest place it knows of."""
    w = _cell_width(level)
    half = 0.75 * w * geo.METERS_PER_DEGREE + 1.0  # no point of a cell is farther from its middle; a metre for rounding
    known = geo.haversine_m("olat", "olon", "rlat", "rlon")
    if boxed:
        slack = 1e-9
        over = [(F.col(c) * w <= F.col(hi) + slack) & ((F.col(c) + 1) * w >= F.col(lo) - slack) for c, lo, hi in (("y", "south", "north"), ("x", "west", "east"))]
        looked = looked.where(over[0] & over[1])
        known = F.when(_within("rlat", "rlon"), known)
    middle = geo.haversine_m(F.col("olat"), F.col("olon"), (F.col("y") + 0.5) * w, (F.col("x") + 0.5) * w)
    rows = looked.withColumns({"_known": F.least("bound", known), "_low": middle - half})  # least passes over NULL
    rows = rows.withColumn("bound", F.min("_known").over(Window.partitionBy(*keys)))
    return rows.where("bound IS NULL OR _low <= bound").select(*keys, "bound", "y", "x", "n")


LEVELS = 21


def box_level(south: Column, north: Column, west: Column, east: Column) -> Column:
    """Finest level whose cells are at least as wide as the box, so a box touches at most 2 × 2 cells."""
    span = F.greatest(north - south, east - west, F.lit(360.0 / 2 ** (LEVELS - 1)))
    return F.greatest(F.lit(0), F.least(F.lit(LEVELS - 1), F.floor(F.log2(F.lit(360.0) / span)).cast("int")))


def ordered_boxes(boxes: DataFrame) -> DataFrame:
    """Boxes with their corners in order; those with a corner that is missing or not finite hold nothing and go."""
    return boxes.where(geo.finite("south", "north", "west", "east")).withColumns({
        "south": F.least("south", "north"), "north": F.greatest("south", "north"), "west": F.least("west", "east"), "east": F.greatest("west", "east")})


def points_in_boxes(
    points: DataFrame, boxes: DataFrame, lat: str = "latitude", lon: str = "longitude", hot_rows: int | None = None
) -> DataFrame:
    """Inner join of points with boxes(south, north, west, east), edges included.

    Corners may come in any order; a box with a corner that is missing or not finite holds nothing. Each box is filed
    under the grid level of its size; points are filed under the levels in use (at most 21 numbers, read to the
    driver) and the two meet in an equi-join. With `hot_rows`, the points of a cell with more of them are dealt to several
    tasks, as large boxes have few cells.
    """
    boxes = ordered_boxes(boxes)
    boxes = boxes.withColumn("_lv", box_level(F.col("south"), F.col("north"), F.col("west"), F.col("east")))
    levels = sorted(r[0] for r in boxes.select("_lv").where("_lv is not null").distinct().collect())
    if not levels:
        levels = [0]
    width = F.lit(360.0) / F.pow(F.lit(2.0), F.col("_lv"))

    def at(v, w):
        return F.floor(v / w).cast("long")

    filed = (
        boxes.withColumn("_y", F.explode(F.sequence(at(F.col("south"), width), at(F.col("north"), width))))
        .withColumn("_x", F.explode(F.sequence(at(F.col("west"), width), at(F.col("east"), width))))
    )
    pts = (
        points.where(geo.finite(lat, lon)).withColumn("_lv", F.explode(F.array(*[F.lit(v) for v in levels])))
        .withColumn("_y", at(F.col(lat), width)).withColumn("_x", at(F.col(lon), width))
    )
    met = skew_join(pts, filed, ["_lv", "_y", "_x"], hot_rows=hot_rows, grown=True)
    inside = F.col(lat).between(F.col("south"), F.col("north")) & F.col(lon).between(F.col("west"), F.col("east"))
    return met.where(inside).drop("_lv", "_y", "_x")
