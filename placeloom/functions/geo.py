"""Distance, datum shift, boxes and grid cells as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from placeloom import dims

METERS_PER_DEGREE = 111194.0  # never more than one degree of arc, so a cell is never narrower than asked


def haversine_m(lat1, lon1, lat2, lon2, unknown: str = "inf") -> Column:
    """Great-circle metres.

    unknown='inf'  : a missing or non-finite coordinate is infinitely far
    unknown='zero' : as above and a coordinate equal to 0 means unknown; result NULL
    """
    pts = [F.col(c) if isinstance(c, str) else c for c in (lat1, lon1, lat2, lon2)]
    a1, o1, a2, o2 = [F.radians(p) for p in pts]
    h = F.pow(F.sin((a2 - a1) / 2), 2) + F.cos(a1) * F.cos(a2) * F.pow(F.sin((o2 - o1) / 2), 2)
    h = F.least(h, F.lit(1.0))
    meters = dims.EARTH_RADIUS_M * 2 * F.atan2(F.sqrt(h), F.sqrt(1 - h))
    good = finite(*pts)
    if unknown == "zero":
        for p in pts:
            good = good & (p != 0)
        return F.when(good, meters)
    return F.when(good, meters).otherwise(F.lit(float("inf")))


def finite(*cols) -> Column:
    out = F.lit(True)
    for c in cols:
        c = F.col(c) if isinstance(c, str) else c
        out = out & c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    return out


def js_round(c: Column) -> Column:
    """Halves go up, also below zero."""
    return F.floor(c + 0.5)


def in_box(lat, lon, box) -> Column:
    south, north, west, east = box
    lat, lon = (F.col(c) if isinstance(c, str) else c for c in (lat, lon))
    return finite(lat, lon) & lat.between(south, north) & lon.between(west, east)


def cities_at(lat, lon) -> Column:
    """All cities whose box holds the point; boxes overlap, so this is an array."""
    hits = [F.when(in_box(lat, lon, box), F.lit(city)) for city, box in dims.CITY_BOXES.items()]
    return F.array_compact(F.array(*hits))


def city_of_address(address) -> Column:
    address = F.col(address) if isinstance(address, str) else address
    out = None
    for city, prefixes in dims.CITY_PREFIXES.items():
        cond = address.startswith(prefixes[0])
        for p in prefixes[1:]:
            cond = cond | address.startswith(p)
        out = F.when(cond, F.lit(city)) if out is None else out.when(cond, F.lit(city))
    return out.otherwise(F.lit(""))


def wgs84_to_gcj02(lat, lon) -> tuple[Column, Column]:
    """Shifted (latitude, longitude). Series coefficients are fixed values of the public datum formula."""
    lat, lon = (F.col(c) if isinstance(c, str) else c for c in (lat, lon))
    axis, ecc = 6378245.0, 0.006693421622965943
    pi = math.pi
    x, y = lon - 105.0, lat - 35.0
    root = F.sqrt(F.abs(x))

    def wave(v, *terms):
        return sum((amp * F.sin(v * pi * mult) for amp, mult in terms), F.lit(0.0)) * 2 / 3

    ripple = wave(x, (20, 6), (20, 2))
    dlat = (-100 + 2 * x + 3 * y + 0.2 * y * y + 0.1 * x * y + 0.2 * root
            + ripple + wave(y, (20, 1), (40, 1 / 3)) + wave(y, (160, 1 / 12), (320, 1 / 30)))
    dlon = (300 + x + 2 * y + 0.1 * x * x + 0.1 * x * y + 0.1 * root
            + ripple + wave(x, (20, 1), (40, 1 / 3)) + wave(x, (150, 1 / 12), (300, 1 / 30)))
    rad = F.radians(lat)
    magic = 1 - ecc * F.sin(rad) * F.sin(rad)
    sq = F.sqrt(magic)
    return (
        lat + dlat * 180 / ((axis * (1 - ecc)) / (magic * sq) * pi),
        lon + dlon * 180 / (axis / sq * F.cos(rad) * pi),
    )


def grid_row(lat, radius_m: float) -> Column:
    lat = F.col(lat) if isinstance(lat, str) else lat
    return F.floor(lat / F.lit(radius_m / METERS_PER_DEGREE)).cast("long")


def grid_cols(row: Column, radius_m: float) -> Column:
    """Number of columns of a grid row around the globe: each at least the radius wide at the row's outermost neighbour
    latitude. Rows next to a pole, and rows with room for two columns only, are one cell."""
    step = radius_m / METERS_PER_DEGREE
    edge = (F.abs(row) + 2) * F.lit(step)
    n = F.floor(F.lit(360 / (step * 1.000001)) * F.cos(F.radians(F.least(edge, F.lit(89.9))))).cast("long")
    return F.when((edge >= 89.9) | (n < 3), F.lit(1).cast("long")).otherwise(n)


def grid_col(lon, row: Column, radius_m: float) -> Column:
    """Column number inside a grid row; columns go round the globe, so ±180° are the same border."""
    lon = F.col(lon) if isinstance(lon, str) else lon
    n = grid_cols(row, radius_m)
    return F.pmod(F.floor((lon + 180) / 360 * n).cast("long"), n)


def inset_box(south: Column, north: Column, top_ratio: Column, bottom_ratio: Column) -> tuple[Column, Column]:
    """Shrink a latitude span by the covered share at the top and the bottom, each limited to 0..0.45."""
    def clamp(r):
        return F.greatest(F.lit(0.0), F.least(F.coalesce(F.nanvl(r, F.lit(0.0)), F.lit(0.0)), F.lit(0.45)))

    span = north - south
    return south + span * clamp(bottom_ratio), north - span * clamp(top_ratio)


def distance_text(km: Column) -> Column:
    """'' for unknown, whole metres below 1 km, else one decimal of the exact value with ties going up."""
    meters = F.concat(js_round(km * 1000).cast("string"), F.lit(" 米"))
    tie = F.pmod(km * 4, F.lit(2.0)) == 1  # x.25 and x.75 are the only exact ties
    shown = F.when(tie, js_round(km * 10) / 10).otherwise(km)
    far = F.concat(F.call_function("format_number", shown, F.lit("0.0")), F.lit(" 公里"))
    return F.when(finite(km) & (km >= 0), F.when(km < 1, meters).otherwise(far)).otherwise(F.lit(""))
