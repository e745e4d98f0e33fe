"""Candidate scoring, best-candidate verdicts, existing-record matches and reconcile steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from placeloom import dims
from placeloom.functions import geo, keys as K, rules, text as T
from placeloom.operators.grid import near_pairs
from placeloom.operators.scale import first_per_key, keep_value, skew_join
from placeloom.operators.duplicates import grid_conflicts  # noqa: F401  (re-exported for callers)
from placeloom.session import cut_lineage


def score_columns(name="name", address="address", cand_name="cand_name", cand_address="cand_address") -> dict[str, Column]:
    """Score parts of one place × candidate row."""
    di, dc = T.canonical_district(address), T.canonical_district(cand_address)
    district = (di == "") | (dc == "") | (di == dc)
    door = T.roads_match(T.road_numbers(address), T.road_numbers(cand_address))
    name_ok = T.names_related(T.normalize_name(name), T.normalize_name(cand_name))
    same_address = T.normalize_address(address) == T.normalize_address(cand_address)
    score = (F.when(district, 15).otherwise(0) + F.when(door, 60).otherwise(0) + F.when(name_ok, 25).otherwise(0)
             + F.when(~door & same_address, 60).otherwise(0))
    return {
        "score": score, "district_match": district, "street_number_match": door, "name_match": name_ok,
        "accepted": district & door & (score >= 75),
    }


def parse_side(rows: DataFrame, name: str, address: str, tag: str) -> DataFrame:
    parsed = rows.withColumn("_b" + tag, T.road_text(address)).withColumns({
        "_d" + tag: T.canonical_district(address), "_r" + tag: T.roads_in("_b" + tag),
        "_n" + tag: T.normalize_name(name), "_a" + tag: T.normalize_address(address)})
    return parsed.drop("_b" + tag)


def parse_places(places: DataFrame) -> DataFrame:
    """Places with the parsed columns that score_candidates compares; made before the join, they cost once a place."""
    return parse_side(places, "name", "address", "i")


def score_candidates(pairs: DataFrame) -> DataFrame:
    """place × candidate rows with score, flags and movement; the two regex-heavy address parses run once a row, that of a
    place once a place if the rows come from parse_places."""
    parsed = parse_side(pairs if "_di" in pairs.columns else parse_places(pairs), "cand_name", "cand_address", "c")
    flags = parsed.withColumns({
        "district_match": (F.col("_di") == "") | (F.col("_dc") == "") | (F.col("_di") == F.col("_dc")),
        "street_number_match": T.roads_match(F.col("_ri"), F.col("_rc")),
        "name_match": T.names_related(F.col("_ni"), F.col("_nc")),
    })
    score = (F.when(F.col("district_match"), 15).otherwise(0) + F.when(F.col("street_number_match"), 60).otherwise(0)
             + F.when(F.col("name_match"), 25).otherwise(0)
             + F.when(~F.col("street_number_match") & (F.col("_ai") == F.col("_ac")), 60).otherwise(0))
    out = flags.withColumn("score", score)
    out = out.withColumn("accepted", F.col("district_match") & F.col("street_number_match") & (F.col("score") >= 75))
    d = geo.haversine_m("latitude", "longitude", "cand_latitude", "cand_longitude")
    return out.withColumn("movement_m", geo.js_round(d)).drop("_ri", "_rc", "_ai", "_ac")


def score_nature(name, address_hint, district, cand_name, cand_address, in_city: Column, address_search: Column) -> dict[str, Column]:
    a, b = T.normalize_name(name, "nature"), T.normalize_name(cand_name, "nature")
    same = (a != "") & (b != "") & ((a == b) | ((F.length(a) >= 4) & T.contains_either(a, b)))
    ds = F.coalesce(F.nullif(T.extract_district(district), F.lit("")), T.extract_district(address_hint))
    dm = T.extract_district(cand_address)
    district_ok = (ds == "") | (dm == "") | (ds == dm)
    has_address = T.text(cand_address) != ""
    supported = address_search & (T.text(address_hint) != "") & district_ok
    score = F.when(same, 70).otherwise(0) + F.when(district_ok, 20).otherwise(0) + F.when(has_address, 10).otherwise(0)
    return {
        "score": score, "name_match": same, "district_match": district_ok,
        "accepted": in_city & has_address & ((same & district_ok) | supported),
        "basis": F.when(supported & ~same, "official_location_and_map_match").otherwise("map_exact_identity"),
    }


def _city_roads(c) -> Column:
    base = T.clean_text(c)
    parts = [F.regexp_extract_all(base, F.lit(dims.ROAD_NUMBER_NEW_CITY), F.lit(i)) for i in (1, 2)]
    road = lambda r: T.sub(r, ("^.*(?:省|市|区|县|街道|镇|乡)", ""), ("大道", "路"), ("公路", "路"))
    return F.transform(F.arrays_zip(parts[0].alias("r"), parts[1].alias("n")), lambda m: F.struct(road(m["r"]).alias("r"), m["n"].alias("n")))


def sorted_letters(c: Column) -> Column:
    return F.array_join(F.array_sort(F.filter(F.split(c, ""), lambda v: v != "")), "")


def score_new_city(name, address, cand_name, cand_address, in_city: Column) -> dict[str, Column]:
    a, b = T.normalize_name(name, "new_city"), T.normalize_name(cand_name, "new_city")
    name_ok = T.names_related(a, b)
    la, lb = (sorted_letters(F.regexp_replace(x, "点", "")) for x in (a, b))
    exact = (a != "") & (b != "") & ((a == b) | ((F.length(la) >= 5) & (la == lb)))
    di, dc = T.extract_district(address), T.extract_district(cand_address)
    district_ok = (di == "") | (dc == "") | (di == dc)
    source = F.when(T.text(cand_address) != "", T.text(cand_address)).otherwise(T.text(cand_name))
    road_ok = F.exists(_city_roads(address), lambda x: F.exists(_city_roads(source), lambda y: (
        (x["n"] == y["n"]) & (x["r"].endswith(y["r"]) | y["r"].endswith(x["r"])))))
    identity = exact & (dc != "") & (T.text(cand_address) != "")
    score = (F.when(name_ok, 25).otherwise(0) + F.when(district_ok, 15).otherwise(0)
             + F.when(road_ok, 60).otherwise(0) + F.when(identity, 75).otherwise(0))
    return {
        "score": score, "name_match": name_ok, "district_match": district_ok, "street_number_match": road_ok,
        "exact_name_match": exact, "accepted": in_city & district_ok & (road_ok | identity),
    }


def score_suzhou(name, address, cand_name, cand_address, in_city: Column) -> dict[str, Column]:
    a, b = T.normalize_name(name, "suzhou"), T.normalize_name(cand_name, "suzhou")
    name_ok = T.names_related(a, b)
    tokens = F.regexp_extract_all(T.text(address), F.lit(dims.STREET_TOKEN), F.lit(0))
    flat = F.regexp_replace(T.text(cand_address), " ", "")
    address_ok = F.exists(tokens, lambda t: flat.contains(t))
    score = F.when(name_ok, 45).otherwise(0) + F.when(address_ok, 65).otherwise(0) + F.when(in_city, 10).otherwise(-100)
    return {"score": score, "name_match": name_ok, "address_match": address_ok}


def name_relation(a: Column, b: Column, cand_name: Column) -> Column:
    """2 equal, 1 contained (both at least four characters), 0 unrelated or a subordinate point."""
    near = (F.length(a) >= 4) & (F.length(b) >= 4) & T.contains_either(a, b)
    return F.when((a == "") | (b == "") | cand_name.rlike(dims.SUBORDINATE_POI), 0).when(a == b, 2).when(near, 1).otherwise(0)


def best_candidates(scored: DataFrame, prefer_poi: bool = False, max_poi_move: int = 600) -> DataFrame:
    """Verdict per place from scored rows (kind 'address' or 'poi').

    Every pick is a minimum over an order struct, so it is a partial aggregate and a place with very many
    candidates is never gathered.
    """
    relation = name_relation(F.col("_ni"), F.col("_nc"), F.col("cand_name"))
    plain_related = T.names_related(F.col("_ni"), F.col("_nc"))
    district_ok = (F.col("_d") == "") | (F.col("_dk") == "") | (F.col("_d") == F.col("_dk"))
    s = scored.withColumns({"rel": relation, "_d": T.extract_district("address"), "_dk": T.extract_district("cand_address")})
    pick = lambda *k: F.struct(*k, F.col("cand_no"), F.col("movement_m").alias("mv"))
    is_address = F.col("kind") == "address"
    agg = s.groupBy("place_id").agg(
        F.first("address").alias("address"),
        F.min(F.when(is_address & F.col("accepted"), pick((-F.col("score")).alias("s"), F.col("movement_m").alias("m")))).alias("addr"),
        F.min(F.when(~is_address & (F.col("rel") > 0) & district_ok & (F.col("movement_m") <= max_poi_move),
                     pick((-F.col("rel")).alias("s"), F.col("movement_m").alias("m")))).alias("poi"),
        F.min(F.when(is_address & plain_related & (F.col("movement_m") <= 120), pick())).alias("near"),
    )
    agg = agg.withColumn("_b", T.road_text("address")).withColumn("_near", F.col("near").isNotNull() & (T.first_road(F.col("_b")) == ""))
    poi, addr, near = F.col("poi").isNotNull(), F.col("addr").isNotNull(), F.col("_near")
    first = [(poi, "poi", "verified_poi"), (addr, "addr", "verified_address")]
    if not prefer_poi:
        first.reverse()
    chain = first + [(near, "near", "verified_poi")]
    status, number, move = None, None, None
    for cond, c, st in chain:
        status = F.when(cond, st) if status is None else status.when(cond, st)
        number = F.when(cond, F.col(f"{c}.cand_no")) if number is None else number.when(cond, F.col(f"{c}.cand_no"))
        move = F.when(cond, F.col(f"{c}.mv")) if move is None else move.when(cond, F.col(f"{c}.mv"))
    return agg.select("place_id", status.otherwise("unverified").alias("status"), number.alias("cand_no"), move.alias("movement_m"))


# ---- does a candidate already exist? -------------------------------------------

def _ids(df: DataFrame) -> DataFrame:
    return df.select("cand_id", "place_id")


def _on(cands: DataFrame, places: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """Equi-join on derived keys that must not be empty ('' never matches); only the smallest place of a key takes part."""
    c, p = cands, places
    for k, expr in keys.items():
        c, p = c.withColumn("k_" + k, expr), p.withColumn("k_" + k, expr)
    names = ["k_" + k for k in keys]
    last = names[-1]
    c = c.where(F.col(last) != "").select("cand_id", *names)
    p = p.where(F.col(last) != "").groupBy(*names).agg(F.min("id").alias("place_id"))
    return skew_join(c, p, names)


def _first_match(parts: list[DataFrame]) -> DataFrame:
    """Smallest matching place per candidate over all disjuncts."""
    out = None
    for p in parts:
        m = p.groupBy("cand_id").agg(F.min("place_id").alias("place_id"))  # shrink before the union
        out = m if out is None else out.unionByName(m)
    return out.groupBy("cand_id").agg(F.min("place_id").alias("place_id"))


def match_existing(cands: DataFrame, places: DataFrame, variant: str) -> DataFrame:
    """(cand_id, place_id): the smallest existing place that counts as the candidate; one join per disjunct.

    door_or_name_district : same first door number, or related name in the same district (same category)
    name_address_60m      : equal name or equal address or nearer than 60 m (one category)
    address_name_contained: equal address, equal name, or contained name of 6+ characters within 150 m
    exact_name_or_address : name or address equal as written
    name_40m              : equal normalised name nearer than 40 m
    """
    c = cands.select("cand_id", F.col("cand_id").alias("id"), "name", "category", "address", "latitude", "longitude")
    p = places.select("id", "name", "category", "address", "latitude", "longitude")
    cat = {"cat": F.col("category")}
    if variant == "door_or_name_district":
        door = _on(c, p, {**cat, "road": T.note_road_number("address")})
        named = _related_names(c, p)
        return _first_match([_ids(door), named])
    if variant == "name_address_60m":
        near = _near(c, _smallest(p), 60.0)
        return _first_match([
            _ids(_on(c, p, {**cat, "n": T.normalize_name("name")})), _ids(_on(c, p, {**cat, "a": T.normalize_address("address")})),
            near.where(F.col("distance") < 60).select("cand_id", "place_id")])
    if variant == "address_name_contained":
        return _first_match([
            _ids(_on(c, p, {**cat, "a": T.normalize_address("address", "dedupe")})), _ids(_on(c, p, {**cat, "n": T.dedupe_key("name")})),
            *_near_contained(c, p, 150.0, 6)])
    if variant == "exact_name_or_address":
        return _first_match([_ids(_on(c, p, {**cat, "n": F.col("name")})), _ids(_on(c, p, {**cat, "a": F.col("address")}))])
    if variant == "name_40m":
        key = lambda df: df.withColumn("nm", T.normalize_name("name"))
        met = near_pairs(key(c), _smallest(key(p), "nm"), 40.0, ["category", "nm"]).where(F.col("distance") < 40)
        return _first_match([met.select(F.col("l_id").alias("cand_id"), F.col("r_id").alias("place_id"))])
    raise ValueError(variant)


def _smallest(p: DataFrame, *more: str) -> DataFrame:
    """One row, the smallest id, of the places that stand at one point (and agree in `more`)."""
    at = p.groupBy("category", "latitude", "longitude", *more).agg(F.min("id").alias("id"))
    return at if "name" in more else at.withColumn("name", F.lit(""))


def _near_contained(c: DataFrame, p: DataFrame, radius: float, n: int) -> list[DataFrame]:
    """(cand_id, place_id) within the radius in one category, one name of n or more letters inside the other; two parts.

    Names are normalised once a row. A contained name starts with one of the longer name's n-grams, so rows meet on cell
    and n-gram, and a crowded spot does not cost all its pairs.
    """
    def named(df):
        key = T.dedupe_key("name")
        return keep_value(df.select("id", "category", "latitude", "longitude", "name"), "nm", F.when(F.length(key) >= n, key)).drop("name")

    def met(short, long):
        start = short.withColumn("gram", F.substring("nm", 1, n))
        pieces = long.withColumn("gram", F.explode(F.array_distinct(T.ngrams("nm", n))))
        return near_pairs(start, pieces, radius, ["category", "gram"]).where(F.col("r_nm").contains(F.col("l_nm")))

    c, p = cut_lineage(named(c)), cut_lineage(_smallest(named(p), "nm").drop("name"))
    return [met(c, p).select(F.col("l_id").alias("cand_id"), F.col("r_id").alias("place_id")),
            met(p, c).select(F.col("r_id").alias("cand_id"), F.col("l_id").alias("place_id"))]


def _near(c: DataFrame, p: DataFrame, radius: float) -> DataFrame:
    met = near_pairs(c.drop("cand_id"), p, radius, ["category"])
    return met.select(F.col("l_id").alias("cand_id"), F.col("r_id").alias("place_id"), F.col("l_name").alias("c_name"), F.col("r_name").alias("p_name"), "distance")


def _related_names(c: DataFrame, p: DataFrame) -> DataFrame:
    """Contained normalised names in the same category and district.

    Works on distinct names; the contained one meets the containing one on its rarest bigram (or its only
    letter), so the meeting groups are as small as the names allow.
    """
    key = lambda df, i: df.select(
        F.col("id").alias(i), "category", T.extract_district("address").alias("district"), T.normalize_name("name", "notes").alias("nm")
    ).where("nm <> ''")
    cs, ps = key(c, "cand_id"), key(p, "place_id")
    keys = ["category", "district"]

    def names(df):
        return df.select(*keys, "nm").distinct()

    def grams(n):
        return F.array_distinct(T.ngrams("nm", n))

    def contained(short, long):
        index = names(long).withColumn("gram", F.explode(F.array_union(grams(2), grams(1))))
        df = index.groupBy(*keys, "gram").agg(F.count(F.lit(1)).alias("df"))
        own = names(short).withColumn("gram", F.explode(F.when(F.length("nm") > 1, grams(2)).otherwise(grams(1))))
        rare = own.join(df, [*keys, "gram"]).groupBy(*keys, "nm").agg(F.min(F.struct("df", "gram")).alias("m"))
        probe = rare.select(*keys, F.col("nm").alias("s"), F.col("m.gram").alias("gram"))
        met = skew_join(index.withColumnRenamed("nm", "l"), probe, [*keys, "gram"])
        return met.where(F.col("l").contains(F.col("s"))).select(*keys, "s", "l")

    up = contained(cs, ps).select(*keys, F.col("s").alias("cn"), F.col("l").alias("pn"))
    down = contained(ps, cs).select(*keys, F.col("l").alias("cn"), F.col("s").alias("pn"))
    # smallest place per name first: all places of one name answer alike
    first = ps.groupBy(*keys, F.col("nm").alias("pn")).agg(F.min("place_id").alias("place_id"))
    best = up.unionByName(down).join(first, [*keys, "pn"]).groupBy(*keys, "cn").agg(F.min("place_id").alias("place_id"))
    return skew_join(cs.withColumnRenamed("nm", "cn"), best, [*keys, "cn"]).select("cand_id", "place_id")


# ---- reconcile ------------------------------------------------------------------

def reconcile_positions(audit: DataFrame, current: DataFrame) -> DataFrame:
    """audit(id, status, map_latitude, map_longitude, poi_latitude, poi_longitude) → action per known place."""
    j = current.select("id", "latitude", "longitude").join(audit, "id")
    second = F.col("poi_latitude").isNotNull()
    lat = F.when(second, F.col("poi_latitude")).otherwise(F.col("map_latitude"))
    lon = F.when(second, F.col("poi_longitude")).otherwise(F.col("map_longitude"))
    j = j.withColumn("new_latitude", lat).withColumn("new_longitude", lon)
    d = geo.haversine_m("latitude", "longitude", "new_latitude", "new_longitude")
    j = j.withColumn("d", d)
    finite = F.col("d") < F.lit(float("inf"))
    action = (
        F.when(second, F.when(finite & (F.col("d") >= 10), "move").otherwise("keep"))
        .when(F.col("status") != "located", "review")
        .when(~finite | (F.col("d") > 500), "review")
        .when(F.col("d") >= 10, "move").otherwise("keep")
    )
    reason = (
        F.when(second, "second_pass_poi").when(F.col("status") != "located", F.col("status"))
        .when(~finite | (F.col("d") > 500), "moved_over_500m").otherwise("located_within_500m")
    )
    return j.select("id", action.alias("action"), reason.alias("reason"), F.when(finite, geo.js_round(F.col("d"))).alias("movement_m"))


def reconcile_addresses(audit: DataFrame, overrides: DataFrame, current: DataFrame) -> DataFrame:
    """Address and position after an audit: manual override, else a better verified candidate, else the repaired address.

    audit(id, status, cand_address, cand_latitude, cand_longitude, name_relation, accepted)
    overrides(id, o_address, o_latitude, o_longitude); Spark broadcasts them when their size allows.
    """
    j = current.select("id", "name", "address", "latitude", "longitude").join(audit, "id").join(overrides, "id", "left")
    j = j.withColumn("own", T.repair_address("address")).withColumn("cand", T.repair_address("cand_address"))
    j = j.withColumns({
        "own_issues": F.size(T.address_issues("own")), "cand_issues": F.size(T.address_issues("cand")),
        "own_score": T.address_score("own"), "cand_score": T.address_score("cand"),
        "own_district": T.extract_district("own"), "cand_district": T.extract_district("cand"),
        "exact_poi": (F.col("status") == "verified_poi") & (F.col("name_relation") == 2),
        "good_address": (F.col("status") == "verified_address") & F.col("accepted"),
        "moved": geo.haversine_m("latitude", "longitude", "cand_latitude", "cand_longitude"),
    })
    district_ok = (F.col("own_district") == "") | (F.col("cand_district") == "") | (F.col("own_district") == F.col("cand_district"))
    trusted = F.col("cand_address").isNotNull() & district_ok & (F.col("exact_poi") | F.col("good_address"))
    better = trusted & (F.col("cand_issues") == 0) & ((F.col("cand_score") > F.col("own_score")) | (F.col("own_issues") > 0))
    limit = F.when(F.col("exact_poi"), 1500).otherwise(500)
    move = trusted & (F.col("moved") >= 10) & (F.col("moved") <= limit)
    manual = F.col("o_address").isNotNull()
    out = j.select(
        "id", "name", "status", F.col("address").alias("old_address"), F.col("latitude").alias("old_lat"), F.col("longitude").alias("old_lon"),
        F.when(manual, F.col("o_address")).when(better, F.col("cand")).otherwise(F.col("own")).alias("address"),
        F.when(manual, F.coalesce("o_latitude", "latitude")).when(move, F.col("cand_latitude")).otherwise(F.col("latitude")).alias("latitude"),
        F.when(manual, F.coalesce("o_longitude", "longitude")).when(move, F.col("cand_longitude")).otherwise(F.col("longitude")).alias("longitude"),
        F.when(manual, "manual").when(better | move, F.when(F.col("exact_poi"), "same_name_poi").otherwise("address_match"))
        .when(F.col("own") != F.col("address"), "address_repair").otherwise("").alias("source"),
    )
    changed = (F.col("address") != F.col("old_address")) | ~F.col("latitude").eqNullSafe(F.col("old_lat")) | ~F.col("longitude").eqNullSafe(F.col("old_lon"))
    return out.withColumn("changed", changed).withColumn("hold_issues", F.array_join(T.address_issues("address"), ",")).withColumn(
        "movement_m", geo.js_round(geo.haversine_m("old_lat", "old_lon", "latitude", "longitude")))


def city_pass_reason(status, name, cand_name, cand_address, movement) -> Column:
    """Hold reason of the city-wide address pass; '' means the candidate may be applied."""
    def key(c):
        return T.sub(T.text(c), ("^(?:上海市?|苏州市?)", ""), (r"[（）()·\s]", ""), ("(?:北门|南门|东门|西门|入口)$", ""))

    p, c = key(name), key(cand_name)
    matches = F.when(F.length(p) <= 3, p == c).otherwise(T.contains_either(p, c))
    a = T.text(cand_address)
    in_target = a.startswith("上海市") | a.startswith("苏州市") | a.startswith("苏州高新区")
    return rules.first_reason([
        ("no_verified_map_poi", ~T.text(status).isin("verified_poi", "verified_address")),
        ("candidate_name_mismatch", ~matches),
        ("address_not_specific", ~in_target | (F.length(a) > 80) | ~a.rlike(dims.PROBLEM_LOCATOR)),
        ("movement_over_3000m", F.coalesce(F.col(movement) if isinstance(movement, str) else movement, F.lit(0)) > 3000),
    ])


def newest_by_key(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    return first_per_key(rows, keys, order)


def carry_over(source: DataFrame, target: DataFrame, source_order: list, target_order: list, reviewed_through: int, rejected: Column) -> DataFrame:
    """Reviewed and rejected numbers of one manifest under the numbers of another, matched by place and url.

    Numbers are positions over the whole manifest; a repeated target key counts with its last number.
    """
    from placeloom.operators.scale import rank_within

    s = rank_within(source.select("photo_id", "place_id", "url"), [], source_order, "source_no").where(F.col("source_no") <= reviewed_through)
    g = rank_within(target.select("photo_id", "place_id", "url"), [], target_order, "target_no")
    last = g.groupBy("place_id", "url").agg(F.max("target_no").alias("target_no"))
    return s.join(last, ["place_id", "url"]).select("source_no", "target_no", rejected.alias("rejected"))


def resolve_redirects(links: DataFrame, resolutions: DataFrame, keys: list[str]) -> DataFrame:
    """Links with the clean url their redirect leads to; unresolved links and excluded domains are dropped."""
    return keep_value(skew_join(links, resolutions, keys, "left"), "url", K.usable_source("resolved"))


def confirm_provenance(images: DataFrame, archive: DataFrame) -> DataFrame:
    """(image_id, verdict): selected when the image's page was read and lists the same source with the name found."""
    a = archive.where("success and name_found").select(
        K.canonical_url("requested_url").alias("pk"), K.canonical_url("seen_url").alias("sk"))
    a = a.groupBy("pk", "sk").agg(F.lit(True).alias("ok"))
    i = images.withColumn("pk", K.canonical_url("source_page")).withColumn("sk", K.canonical_url("source_url"))
    return skew_join(i, a, ["pk", "sk"], "left").select("image_id", F.when(F.col("ok"), "selected").otherwise("rejected").alias("verdict"))
