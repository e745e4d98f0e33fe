"""Visit log columns and reports; the same expressions run in batch and in streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from placeloom import dims
from placeloom.functions import geo, keys as K
from placeloom.functions.text import text

GEOCODE_SCHEMA = (
    "status INT, result STRUCT<"
    "ad_info: STRUCT<nation: STRING, province: STRING, city: STRING, district: STRING>,"
    "address_component: STRUCT<nation: STRING, province: STRING, city: STRING, district: STRING, street: STRING, street_number: STRING>,"
    "formatted_addresses: STRUCT<standard_address: STRING, recommend: STRING>, address: STRING,"
    "pois: ARRAY<STRUCT<title: STRING, category: STRING, _distance: DOUBLE>>>")


def _filled(*cols) -> Column:
    """First non-empty value, trimmed, '' when there is none."""
    return F.trim(F.coalesce(*[F.nullif(c, F.lit("")) for c in cols], F.lit("")))


def nearby_poi(pois: Column) -> Column:
    """First residential point within 200 m, else the first point within 80 m, else ''."""
    named = F.filter(
        F.transform(pois, lambda p: F.struct(F.trim(F.coalesce(p["title"], F.lit(""))).alias("t"), text_of(p["category"]).alias("c"), p["_distance"].alias("d"))),
        lambda p: (p["t"] != "") & p["d"].isNotNull() & ~F.isnan(p["d"]))
    home = F.filter(named, lambda p: (p["d"] <= 200) & F.concat(p["t"], p["c"]).rlike(dims.RESIDENTIAL))
    close = F.filter(named, lambda p: p["d"] <= 80)
    pick = lambda a: F.try_element_at(a, F.lit(1))["t"]
    return F.coalesce(pick(home), pick(close), F.lit(""))


def text_of(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def flatten_geocode(df: DataFrame, payload: str = "payload", lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    """Nested reverse-geocode answer → flat location columns."""
    p = F.from_json(payload, GEOCODE_SCHEMA)
    r = F.when(p["status"] == 0, p["result"])
    df = df.withColumn("_r", r)
    g = lambda path: F.col(f"_r.{path}")
    province = _filled(g("ad_info.province"), g("address_component.province"))
    city0 = _filled(g("ad_info.city"), g("address_component.city"), province)
    df = df.withColumns({
        "nation": _filled(g("ad_info.nation"), g("address_component.nation")), "province": province, "_city": city0,
        "district": _filled(g("ad_info.district"), g("address_component.district")),
        "street": _filled(g("address_component.street_number"), g("address_component.street")),
        "place_name": nearby_poi(g("pois")),
        "address": _filled(g("formatted_addresses.standard_address"), g("formatted_addresses.recommend"), g("address")),
    })
    in_town = (F.col("_city") == "上海市") | ((F.col("_city") == "") & geo.in_box(lat, lon, dims.VISIT_SHANGHAI_BOX))
    level = (F.when(F.col("place_name") != "", "place").when(F.col("street") != "", "street")
             .when(F.col("district") != "", "district").when(F.col("_city") != "", "city").otherwise("unknown"))
    return df.withColumns({
        "location_level": level, "is_shanghai": in_town,
        "city": F.when(F.col("_city") != "", F.col("_city")).when(in_town, "上海市").otherwise(""),
    }).drop("_r", "_city")


def validate(df: DataFrame) -> DataFrame:
    """Drop events without a finite point, limit the source to its two values, round the accuracy or null it."""
    acc = F.expr("try_cast(accuracy AS DOUBLE)")
    return df.where(geo.finite("latitude", "longitude")).withColumn(
        "source", F.when(F.col("source") == "location_button", "location_button").otherwise("page_open")
    ).withColumn("accuracy", F.when(geo.finite(acc), geo.js_round(acc)).cast("long"))


def ingest(events: DataFrame, aliases: DataFrame, appid: str) -> DataFrame:
    """Raw event → visit row: validated, hashed identity, flat location, visitor name.

    aliases(visitor_id, name): names go by the whole hash, since the six digits of a code are shared by several
    visitors once there are some thousand of them.
    """
    v = validate(events).withColumn("visitor_id", K.visitor_id("openid", F.lit(appid)))
    v = flatten_geocode(v.withColumn("visitor_code", K.visitor_code(F.col("visitor_id"))))
    v = v.join(aliases.select("visitor_id", F.col("name").alias("visitor_name")), "visitor_id", "left")
    return v.withColumn("visitor_name", text("visitor_name")).drop("openid", "payload")


def search(visits: DataFrame, query="", location=None, visitor=None, hide_self=False, time_range=None) -> DataFrame:
    """Conjunctive visit search; a visit without a valid time fails any time range."""
    out = visits
    if location:
        out = out.where(F.concat_ws("|", "province", "city", "district") == location)
    if visitor:
        out = out.where(F.col("visitor_code") == visitor)
    if hide_self:
        out = out.where(F.trim("visitor_name") != "我自己")
    if time_range:
        out = out.where(F.col("created_at").isNotNull() & F.col("created_at").between(F.lit(time_range[0]), F.lit(time_range[1])))
    word = query.strip().lower()
    if word:
        fields = ["visitor_name", "visitor_code", "nation", "province", "city", "district", "street", "place_name", "address"]
        out = out.where(F.lower(F.concat_ws("\u0001", *[text(f) for f in fields])).contains(word))
    return out


def recent(visits: DataFrame, n: int = 500) -> DataFrame:
    return visits.orderBy(F.desc("created_at"), F.asc("id")).limit(n)


def hourly_by_district(visits: DataFrame, time_col: str = "ts", late: str | None = None) -> DataFrame:
    v = visits.withWatermark(time_col, late) if late else visits
    g = v.groupBy(F.window(time_col, "1 hour").alias("w"), "district").agg(F.count(F.lit(1)).alias("visits"))
    return g.select(F.date_format("w.start", "yyyy-MM-dd HH:mm").alias("hour"), "district", "visits")
