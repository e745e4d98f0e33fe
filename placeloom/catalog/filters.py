"""Section B: projections, filters, predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from placeloom import dims
from placeloom.catalog import duck as D
from placeloom.catalog.registry import FLAT_SQL, query
from placeloom.functions import geo, keys as K, rules, text as T
from placeloom.operators import gallery, matching, select, visits as V
from placeloom.operators.scale import first_per_key


@query("b1_viewport", uses="viewports_v places_v", sql="""
    SELECT vid, id, n AS position, total > 200 AS has_more FROM (
      SELECT v.vid, p.id, row_number() OVER (PARTITION BY v.vid ORDER BY p.id) AS n, count(*) OVER (PARTITION BY v.vid) AS total
      FROM viewports_v v JOIN places_v p ON p.latitude BETWEEN v.south AND v.north AND p.longitude BETWEEN v.west AND v.east
       AND (v.category = '全部' OR v.category = p.category)) WHERE n <= 200""")
def b1(t):
    return select.viewport_pages(t("viewports_v"), t("places_v"), 200)


@query("b2_stable_page", uses="places_v", sql="""
    SELECT id, name, count(*) OVER () = 100 AS has_more, 200 + count(*) OVER () AS next_offset
    FROM (SELECT id, name FROM places_v WHERE category = '食堂' ORDER BY id LIMIT 100 OFFSET 200)""")
def b2(t):
    return select.stable_page(t("places_v").where("category = '食堂'").select("id", "name"), 200, 100)


@query("b3_category_filters", uses="places_v", sql=f"""
    SELECT 'all' AS mode, id FROM places_v WHERE category IN ('图书馆', '食堂', '自然') AND NOT ({{ex}})
    UNION ALL SELECT 'two', id FROM places_v WHERE category IN ('食堂', '自然') AND NOT ({{ex}})
    UNION ALL SELECT 'one', id FROM places_v WHERE category = '图书馆' AND NOT ({{ex}})
    UNION ALL SELECT 'no_filter', id FROM places_v""".replace("{ex}", dict(D.issue_list())["excluded_place_type"]))
def b3(t):
    p = t("places_v")
    parts = [("all", select.by_category(p, "全部")), ("two", select.by_categories(p, ["食堂", "自然", "书店"])),
             ("one", select.by_category(p, "图书馆")), ("no_filter", select.by_categories(p, None)),
             ("empty", select.by_categories(p, [])), ("unknown", select.by_category(p, "书店"))]
    out = None
    for mode, df in parts:
        df = df.select(F.lit(mode).alias("mode"), "id")
        out = df if out is None else out.unionByName(df)
    return out


_ISSUES = dict(D.issue_list())
_CLEAN = D.clean("name")


def _b4_sql(cleaned: bool, allow: str) -> str:
    c = _CLEAN if cleaned else "name"
    lib = f"{c} LIKE '%图书馆%'"
    institution = D.like(f"replace({c}, '政府路', '#')", dims.INSTITUTION.replace("政府(?!路)", "政府"))
    return f"""{D.like(c, dims.SCHOOL)} AS school, {institution} AS institution,
        ({c} = '阅闲坊' OR ({D.like(c, dims.EXCLUDED_ROOM + '|' + dims.EXCLUDED_PARTY)} AND NOT {lib})) AS excluded,
        ({D.like(c, allow)} AND NOT {D.like(c, dims.CANTEEN_DENY)}) AS canteen,
        ({D.like(c, dims.NATURE_ALLOW + '|' + dims.NATURE_FREE_NAMES)} AND NOT {D.like(c, dims.NATURE_DENY)}) AS nature"""


def _flags(ruleset):
    return [rules.is_school("name", ruleset).alias("school"), rules.is_institution("name", ruleset).alias("institution"),
            rules.is_excluded_type("name", ruleset).alias("excluded"), rules.is_public_canteen("name", ruleset).alias("canteen"),
            rules.is_public_nature("name", ruleset).alias("nature")]


@query("b4_admission", uses="places_v", sql=f"SELECT id, {_b4_sql(True, dims.CANTEEN_ALLOW['quality'])} FROM places_v")
def b4(t):
    return t("places_v").select("id", *_flags("quality"))


@query("b4b_rule_sets", uses="places_v", sql=f"""
    SELECT id, 'admin' AS ruleset, {_b4_sql(False, dims.CANTEEN_ALLOW['admin'])} FROM places_v
    UNION ALL SELECT id, 'quality', {_b4_sql(True, dims.CANTEEN_ALLOW['quality'])} FROM places_v""")
def b4b(t):
    p = t("places_v")
    return p.select("id", F.lit("admin").alias("ruleset"), *_flags("admin")).unionByName(
        p.select("id", F.lit("quality").alias("ruleset"), *_flags("quality")))


@query("b5_normalise", uses="places_v", sql=r"""
    SELECT coalesce(nullif(CASE WHEN k % 3 = 0 THEN id ELSE '' END, ''), nullif(CASE WHEN k % 3 = 1 THEN 'm' || id ELSE '' END, ''), nullif(name, '')) AS id,
           TRY_CAST(CASE WHEN k % 9 = 0 THEN 'x' ELSE CAST(latitude AS STRING) END AS DOUBLE) AS latitude,
           regexp_replace(trim(regexp_replace(coalesce(nullif(description, ''), hours), '\s+', ' ', 'g')), '[。！？；;，,.!?]+$', '') AS description,
           name || '|' || address AS photos
    FROM places_v""")
def b5(t):
    raw = t("places_v").select(
        F.when(F.col("k") % 3 == 0, F.col("id")).otherwise("").alias("id"),
        F.when(F.col("k") % 3 == 1, F.concat(F.lit("m"), "id")).otherwise("").alias("_id"), F.lit("").alias("placeId"), "name",
        F.when(F.col("k") % 9 == 0, "x").otherwise(F.col("latitude").cast("string")).alias("latitude"),
        F.col("longitude").cast("string").alias("longitude"), "description", F.col("hours").alias("facilities"), "category", "hours", "address",
        F.concat("name", F.lit("|"), "address", F.lit("；， ;")).alias("imageUrls"))
    return select.normalise(raw).select("id", "latitude", "description", F.array_join("photos", "#").alias("photos"))


@query("b6_display", uses="places_v origins_v", sql=r"""
    SELECT id, CASE WHEN trim(address) = '' THEN '地址待补充' ELSE trim(address) END AS address_text,
           CASE WHEN hours <> '' AND hours NOT LIKE '%现场公示%' THEN hours ELSE '—' END AS hours_text,
           CASE WHEN k % 7 = 0 THEN '' WHEN k % 2000 < 1000 THEN CAST(floor((k % 2000) / 1000.0e0 * 1000 + 0.5) AS BIGINT) || ' 米' WHEN k % 500 IN (250) THEN printf('%.1f', floor((k % 2000) / 100.0e0 + 0.5) / 10) || ' 公里' ELSE printf('%.1f', (k % 2000) / 1000.0e0) || ' 公里' END AS distance_text
    FROM places_v""")
def b6(t):
    km = F.when(F.col("k") % 7 != 0, (F.col("k") % 2000) / 1000.0)
    return t("places_v").select("id", *select.display_columns(), geo.distance_text(km).alias("distance_text"))


@query("b7_inset", uses="viewports_v", sql="""
    SELECT vid, round(south + (north - south) * least(0.45e0, bottom_ratio), 6) AS south, round(north - (north - south) * least(0.45e0, top_ratio), 6) AS north FROM viewports_v""")
def b7(t):
    s, n = geo.inset_box(F.col("south"), F.col("north"), F.col("top_ratio"), F.col("bottom_ratio"))
    return t("viewports_v").select("vid", F.round(s, 6).alias("south"), F.round(n, 6).alias("north"))


VISITS = """
    SELECT v.id, v.e, v.created_at, upper(substr(sha256('app:' || v.openid), 1, 6)) AS visitor_code, coalesce(a.name, '') AS visitor_name,
           latitude, longitude, accuracy, v.source,
           CASE WHEN CAST(payload->>'$.status' AS INT) = 0 THEN payload END AS j
    FROM visits_v v LEFT JOIN aliases_v a ON a.openid = v.openid WHERE latitude IS NOT NULL"""
FLAT = f"""raw AS ({VISITS}), loc AS (SELECT *, coalesce(j->>'$.result.ad_info.province', '') AS province,
      CASE WHEN coalesce(j->>'$.result.ad_info.city', '') <> '' THEN j->>'$.result.ad_info.city' ELSE coalesce(j->>'$.result.ad_info.province', '') END AS city0,
      coalesce(j->>'$.result.ad_info.nation', '') AS nation, coalesce(j->>'$.result.ad_info.district', '') AS district,
      coalesce(j->>'$.result.address_component.street', '') AS street, trim(coalesce(j->>'$.result.formatted_addresses.recommend', '')) AS address,
      CASE WHEN CAST(j->>'$.result.pois[1]._distance' AS INT) <= 200 THEN '幸福家园' WHEN CAST(j->>'$.result.pois[0]._distance' AS INT) <= 80 THEN '滨河公园'
           ELSE '' END AS place_name FROM raw),
    flat AS (SELECT *, city0 = '上海市' OR (city0 = '' AND {D.box('latitude', 'longitude', dims.VISIT_SHANGHAI_BOX)}) AS is_shanghai,
      CASE WHEN city0 <> '' THEN city0 WHEN {D.box('latitude', 'longitude', dims.VISIT_SHANGHAI_BOX)} THEN '上海市' ELSE '' END AS city,
      CASE WHEN place_name <> '' THEN 'place' WHEN street <> '' THEN 'street' WHEN district <> '' THEN 'district' WHEN city0 <> '' THEN 'city' ELSE 'unknown' END AS location_level,
      CASE WHEN accuracy = 'n/a' THEN NULL ELSE CAST(floor(CAST(accuracy AS DOUBLE) + 0.5) AS BIGINT) END AS acc,
      CASE WHEN source = 'location_button' THEN source ELSE 'page_open' END AS src FROM loc)"""


FLAT_SQL.append(FLAT)


def visit_rows(t):
    al = t("aliases_v").select(K.visitor_id("openid", F.lit("app")).alias("visitor_id"), "name")
    return V.ingest(t("visits_v"), al, "app")


@query("b8_visit_search", uses="visits_v aliases_v", sql=f"""
    WITH {FLAT} SELECT id, visitor_name, district, location_level FROM flat
    WHERE visitor_name <> '我自己' AND epoch(created_at) BETWEEN 1704067200 AND 1704067200 + 86400 * 20
      AND province = '上海市' AND city = '上海市' AND district = '徐汇区'
      AND contains(lower(concat_ws(chr(1), visitor_name, visitor_code, nation, province, city, district, street, place_name, address)), '家园')""")
def b8(t):
    lo = F.timestamp_seconds(F.lit(1704067200))
    hi = F.timestamp_seconds(F.lit(1704067200 + 86400 * 20))
    found = V.search(visit_rows(t), " 家园 ", "上海市|上海市|徐汇区", hide_self=True, time_range=(lo, hi))
    return found.select("id", "visitor_name", "district", "location_level")


@query("b9_listing", uses="places_v desired_v", sql="""
    SELECT p.id, CASE WHEN d.id IS NOT NULL AND d.description = p.description THEN 'pushed' ELSE 'unpushed' END AS push_state
    FROM places_v p LEFT JOIN desired_v d ON d.id = p.id
    WHERE p.name LIKE '%社区%' AND p.category = '食堂'
      AND CASE WHEN d.id IS NOT NULL AND d.description = p.description THEN 'pushed' ELSE 'unpushed' END = 'unpushed'""")
def b9(t):
    fp = lambda df: df.select("id", "name", "category", K.place_fingerprint(F.lit(0), F.lit(0)).alias("fp"))
    pushed = fp(t("desired_v")).select("id", F.col("fp").alias("pushed_fingerprint"))
    return select.listing(fp(t("places_v")).join(pushed, "id", "left"), "社区", "食堂", "unpushed").select("id", "push_state")


@query("b10_cities", uses="places_v", sql=f"""
    SELECT id, {D.code_list([(c, D.box('latitude', 'longitude', b)) for c, b in dims.CITY_BOXES.items()])} AS cities,
           {D.case([(c, ' OR '.join(f"address LIKE '{p}%'" for p in ps)) for c, ps in dims.CITY_PREFIXES.items()])} AS address_city,
           NOT {D.box('latitude', 'longitude', dims.VISIT_SHANGHAI_BOX)} AS outside_shanghai
    FROM places_v""")
def b10(t):
    return t("places_v").select(
        "id", F.array_join(geo.cities_at("latitude", "longitude"), ",").alias("cities"), geo.city_of_address("address").alias("address_city"),
        (~geo.in_box("latitude", "longitude", dims.VISIT_SHANGHAI_BOX)).alias("outside_shanghai"))


def _note_sql(table, value):
    def one(cat):
        need, *also, deny = table[cat]
        extra = f" AND {D.like(value, also[0])}" if also and also[0] else ""
        return f"({D.like(value, need)}{extra} AND NOT {D.like(value, deny)})"
    return f"CASE WHEN category = '图书馆' THEN {one('图书馆')} ELSE {one('食堂')} END"


@query("b11_note_eligibility", uses="notes_v", sql=f"""
    SELECT note_id, {_note_sql(dims.NOTE_TITLE, 'title')} AS title_ok, {_note_sql(dims.NOTE_BODY, "title || chr(10) || body")} AS body_ok
    FROM notes_v WHERE published >= 1640966400""")
def b11(t):
    n = t("notes_v").where(F.timestamp_seconds("published") >= F.to_timestamp(F.lit(dims.NOTE_CUTOFF)))
    return n.select("note_id", rules.note_title_ok("category", "title").alias("title_ok"),
                    rules.note_body_ok("category", F.concat_ws("\n", "title", "body")).alias("body_ok"))


_N = "regexp_replace(name, '\\s', '', 'g')"
_B12 = [
    ("non_nature_map_category", "map_category NOT IN ('', 'Park', 'Beach')"), ("manual_identity_or_scope_reject", f"{_N} = '前程0公园'"),
    ("weak_type", f"NOT {D.like(_N, dims.CORE_TYPE)}"), ("excluded_name", D.like(_N, dims.REJECT_NAME)),
    ("private_or_subarea_plant_garden", D.like(_N, dims.PRIVATE_PLANT)),
    ("private_ecological_venue", f"{D.like(_N, '生态园$')} AND NOT {D.like(_N, '公生态园$')}"),
    ("cultural_scenic_area", f"{D.like(_N, '景区$')} AND NOT {D.like(f'replace({_N}, {D.q('景区')}, {D.q(' ')})', dims.NATURAL_SCENIC)}"),
    ("ambiguous_natural_feature", f"length({_N}) <= 3 AND {D.like(_N, '(?:山|湖|岛|洲|滩|谷|岭|峰|森林)$')}"),
    ("sub_poi", f"{D.like(_N, dims.SUB_POI.replace('(?!一期|二期|三期|四期)', ''))} OR {D.like('address', dims.SUB_POI.replace('(?!一期|二期|三期|四期)', ''))}"),
    ("road_intersection", D.like(_N, "与.+交叉口")),
    ("existing_name", "e.nm IS NOT NULL"),
]
_NM = r"regexp_replace(regexp_replace({x}, '\s', '', 'g'), '(?:苏州|南通|无锡|嘉兴|镇江)市?|国家级?|省级?|[（）()·•_\-—]', '', 'g')"


@query("b12_poi_cascade", uses="pois_v", sql=f"""
    WITH e AS (SELECT DISTINCT {_NM.format(x='name')} AS nm FROM pois_v WHERE k % 10 = 0)
    SELECT p.id, {D.case(_B12)} AS reason FROM pois_v p LEFT JOIN e ON e.nm = {_NM.format(x='p.name')}""")
def b12(t):
    """Existing places are the pois of every tenth key; an equal name is tested before nearness, so nearness adds nothing."""
    p = t("pois_v").withColumn("nm", T.normalize_name("name", "nature_map"))
    existing = p.where("k % 10 = 0").select("nm").distinct().withColumn("known", F.lit(True))
    first = rules.map_poi_reason("name", "address", "map_category", ["前程0公园"])
    j = p.join(existing, "nm", "left")
    return j.select("id", F.when((first == "") & F.col("known"), "existing_name").otherwise(first).alias("reason"))


_B13 = [
    ("category", "c.category NOT IN ('图书馆', '食堂')"), ("empty_name_or_address", f"{D.clean('c.name')} = '' OR {D.clean('c.address')} = ''"),
    ("no_door_number", f"{D.road_first('c.address')} = ''"), ("bad_point", f"NOT {D.box('c.latitude', 'c.longitude', (18, 54, 73, 136))}"),
    ("name_without_library", "c.category = '图书馆' AND c.name NOT LIKE '%图书馆%'"), ("missing_hours", "c.category = '图书馆' AND c.hours = ''"),
    ("missing_description", "c.category = '图书馆' AND c.description = ''"),
    ("not_public_canteen", f"c.category = '食堂' AND NOT {D.like('c.name', '社区|长者|老年|市民|邻里|助餐(?:点|服务|食堂)')}"),
    ("duplicate", f"EXISTS (SELECT 1 FROM old o WHERE o.category = c.category AND ((o.nm <> '' AND o.nm = {D.name_quality('c.name')}) OR (o.rd <> '' AND o.rd = {D.road_first('c.address')})))"),
]


@query("b13_candidate_admission", uses="places_v", sql=f"""
    WITH old AS (SELECT DISTINCT category, {D.name_quality('name')} AS nm, {D.road_first('address')} AS rd FROM places_v WHERE k % 3 = 0)
    SELECT c.id, {D.case(_B13)} AS reason FROM places_v c WHERE k % 3 <> 0""")
def b13(t):
    p = t("places_v")
    return select.admit_candidates(p.where("k % 3 <> 0"), p.where("k % 3 = 0"))


_B14 = [
    ("empty_or_padded", "description = '' OR trim(description) <> description"), ("trailing_punctuation", D.like("description", dims.CURATED_TRAILING)),
    ("channel_name", D.like("description", dims.CURATED_CHANNEL)), ("generic_activity", D.like("description", dims.CURATED_GENERIC)),
    ("place_name_in_text", "name <> '' AND contains(description, name)")]
_B14H = [
    ("empty_or_padded", "hours = '' OR trim(hours) <> hours"), ("onsite_notice", "hours LIKE '%现场公示%'"),
    ("no_explicit_time", f"NOT {D.like('hours', '[0-9]{1,2}:[0-9]{2}')}")]


@query("b14_curated_checks", uses="places_v", sql=f"""
    SELECT id, {D.code_list(_B14)} AS description_issues, {D.code_list(_B14H)} AS hours_issues FROM places_v
    WHERE {D.code_list(_B14)} <> '' OR {D.code_list(_B14H)} <> ''""")
def b14(t):
    out = t("places_v").select(
        "id", F.array_join(rules.curated_description_issues("name", "description"), ",").alias("description_issues"),
        F.array_join(rules.curated_hours_issues("hours"), ",").alias("hours_issues"))
    return out.where("description_issues <> '' or hours_issues <> ''")


_NO = r"regexp_extract(p.address, '[0-9]+(?:弄[0-9]+)?号', 0)"


@query("b15_source_policy", uses="places_v notes_v", sql=f"""
    SELECT p.id, n.note_id, CASE
      WHEN {D.like('p.name || p.address', '实验小学|实验中学|大学|学院|学校|校区')} THEN 'school_library'
      WHEN {D.like('p.name || p.address', '机关|检察院|法院|公安局|政务服务中心')} THEN 'restricted_institution'
      WHEN p.category = '图书馆' AND NOT contains(n.body, p.name) THEN 'official_identity_missing'
      WHEN p.category = '食堂' AND ({_NO} = '' OR NOT contains(regexp_replace(n.body, '\\s', '', 'g'), {_NO})
           OR NOT {D.like('n.body', '社区|长者|老年|邻里|助餐|幸福食堂|苏心小厨')}) THEN 'official_public_meal_evidence_missing' ELSE '' END AS reason
    FROM places_v p JOIN notes_v n ON n.place_id = p.id""")
def b15(t):
    j = t("places_v").join(t("notes_v").select(F.col("place_id").alias("id"), "note_id", "body"), "id")
    return j.select("id", "note_id", select.source_policy("name", "category", "address", "name", "body").alias("reason"))


@query("b16_poi_filter", uses="places_v", sql=f"""
    SELECT min(id) AS id, name, address FROM places_v WHERE {D.like('address', '浦东新区|徐汇区|杨浦区|静安区')}
      AND {D.like('name', '社区.*(?:食堂|饭堂)|(?:长者|老年).*(?:食堂|饭堂)|助餐.*(?:食堂|饭堂|餐厅)')} AND NOT {D.like('name', '^(?:社区食堂|长者食堂)$')}
      AND NOT {D.like('name', '大学|机关')} AND {D.like("regexp_replace(address, '^中国上海市[^区]+区', '')", '路|街|弄|号|镇|村|苑|店|门|楼|中心|广场|公寓|大厦|交叉口|菜市场')}
    GROUP BY name, address""")
def b16(t):
    return select.canteen_pois(t("places_v"), ["浦东新区", "徐汇区", "杨浦区", "静安区"], "大学|机关").select("id", "name", "address")


@query("b17_problem_addresses", uses="places_v", sql=f"""
    SELECT id, address FROM places_v WHERE category = '自然' AND (address LIKE '上海市%' OR address LIKE '苏州市%' OR address LIKE '苏州高新区%')
      AND ({D.like('address', dims.PROBLEM_PROSE)} OR NOT {D.like('address', dims.PROBLEM_LOCATOR)})""")
def b17(t):
    a = F.col("address")
    target = (F.col("category") == "自然") & geo.city_of_address("address").isin("上海", "苏州")
    return t("places_v").where(target & (a.rlike(dims.PROBLEM_PROSE) | ~a.rlike(dims.PROBLEM_LOCATOR))).select("id", "address")


@query("b18_reverse_geocode", uses="visits_v aliases_v", sql=f"""
    WITH {FLAT} SELECT id, nation, province, city, district, street, place_name, address, location_level, is_shanghai FROM flat""")
def b18(t):
    return visit_rows(t).select("id", "nation", "province", "city", "district", "street", "place_name", "address", "location_level", "is_shanghai")


@query("b19_visit_validation", uses="visits_v aliases_v", sql=f"WITH {FLAT} SELECT id, acc AS accuracy, src AS source FROM flat")
def b19(t):
    return V.validate(t("visits_v")).select("id", "accuracy", "source")


@query("b20_image_candidates", uses="photos_v notes_v", sql="""
    SELECT f.photo_id FROM photos_v f JOIN notes_v n ON f.o = n.o
    WHERE f.o % 5 <> 0 AND f.o % 7 <> 0 AND least(width, height) >= 480 AND greatest(width, height) <= 3.2 * least(width, height) AND entropy >= 3.2
      AND (SELECT bool_or(contains(x.t, x.a)) FROM (SELECT regexp_replace(lower(n.title), '[^0-9a-z\\x{4e00}-\\x{9fff}]+', '', 'g') AS t,
             unnest([regexp_replace(lower(n.place_name), '[^0-9a-z\\x{4e00}-\\x{9fff}]+', '', 'g'),
                     regexp_replace(lower(regexp_replace(n.place_name, '[（(].*?[）)]', '', 'g')), '[^0-9a-z\\x{4e00}-\\x{9fff}]+', '', 'g')]) AS a) x WHERE length(x.a) >= 4)""")
def b20(t):
    f = t("photos_v").join(t("notes_v").select("o", F.col("title").alias("note_title"), "place_name"), "o")
    url = F.concat(F.when(F.col("o") % 5 == 0, "http").otherwise("https"), F.lit("://"),
                   F.when(F.col("o") % 7 == 0, "ads.blocked.com").otherwise("img.example.com"), "url")
    ok = gallery.usable_image(url, T.alnum_key("note_title"), T.name_aliases("place_name"), "width", "height", "entropy", ["blocked"])
    return f.where(ok).select("photo_id")


@query("b21_selection_check", uses="places_v notes_v", sql="""
    WITH s AS (SELECT place_id, min(CASE WHEN o % 11 = 0 THEN place_name || '改' ELSE place_name END) AS sel_name, count(*) AS images, min(o) AS o FROM notes_v GROUP BY 1)
    SELECT s.place_id, concat_ws(',', CASE WHEN p.id IS NULL THEN 'unknown_place' END, CASE WHEN p.name <> s.sel_name THEN 'name_mismatch' END,
      CASE WHEN p.id IS NOT NULL AND NOT (p.address LIKE '上海市%' OR p.address LIKE '苏州%') THEN 'city_not_allowed' END, CASE WHEN images NOT BETWEEN 1 AND 5 THEN 'image_count' END) AS violations
    FROM s LEFT JOIN (SELECT * FROM places_v WHERE k % 6 <> 1) p ON p.id = s.place_id
    WHERE concat_ws(',', CASE WHEN p.id IS NULL THEN 'unknown_place' END, CASE WHEN p.name <> s.sel_name THEN 'name_mismatch' END,
      CASE WHEN p.id IS NOT NULL AND NOT (p.address LIKE '上海市%' OR p.address LIKE '苏州%') THEN 'city_not_allowed' END, CASE WHEN images NOT BETWEEN 1 AND 5 THEN 'image_count' END) <> ''""")
def b21(t):
    name = F.when(F.col("o") % 11 == 0, F.concat("place_name", F.lit("改"))).otherwise(F.col("place_name"))
    s = t("notes_v").groupBy("place_id").agg(F.min(name).alias("sel_name"), F.count(F.lit(1)).alias("images"))
    return select.selection_violations(s, t("places_v").where("k % 6 <> 1"), ["上海", "苏州"])
