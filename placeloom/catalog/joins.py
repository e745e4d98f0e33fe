"""Section C: joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from placeloom import dims
from placeloom.catalog import duck as D
from placeloom.catalog.registry import query
from placeloom.functions import geo, keys as K, text as T
from placeloom.operators import duplicates as DUP, evidence as EV, matching as M, sync, visits as V
from placeloom.operators.grid import HOT_CELL, near_pairs, nearest
from placeloom.operators.scale import skew_join

from placeloom.catalog.filters import FLAT, visit_rows


@query("c1_distance", uses="cands_v places_v", sql=f"""
    SELECT c.place_id, c.cand_no, {D.rnd(D.meters('p.latitude', 'p.longitude', 'c.cand_latitude', 'c.cand_longitude'))} AS m,
           CASE WHEN p.latitude = 0 OR p.longitude = 0 OR c.cand_latitude = 0 OR c.cand_longitude = 0 THEN NULL
                ELSE {D.rnd(D.meters('p.latitude', 'p.longitude', 'c.cand_latitude', 'c.cand_longitude'))} END AS m_known
    FROM cands_v c JOIN places_v p ON p.id = c.place_id""")
def c1(t):
    j = t("cands_v").join(t("places_v").select(F.col("id").alias("place_id"), "latitude", "longitude"), "place_id")
    pts = ("latitude", "longitude", "cand_latitude", "cand_longitude")
    return j.select("place_id", "cand_no", geo.js_round(geo.haversine_m(*pts)).alias("m"), geo.js_round(geo.haversine_m(*pts, "zero")).alias("m_known"))


REVIEWED = """rev AS (SELECT 'p' || lpad(CAST(c_custkey AS STRING), 8, '0') AS a, 'p' || lpad(CAST(c_custkey + 1 AS STRING), 8, '0') AS b
    FROM customer WHERE c_custkey % 33 = 0)"""


def reviewed_pairs(t):
    """Stand-in for the manually reviewed pair list: every 33rd place and the next one."""
    pid = lambda c: F.concat(F.lit("p"), F.lpad(c.cast("string"), 8, "0"))
    c = t("customer").where("c_custkey % 33 = 0")
    return c.select(pid(F.col("c_custkey")).alias("first_id"), pid(F.col("c_custkey") + 1).alias("second_id"), F.lit("reviewed").alias("reason"))


C2_SQL = f"""
    WITH {REVIEWED},
    named AS (SELECT a AS id FROM rev UNION SELECT b FROM rev),
    x AS (SELECT p.id, p.category, p.latitude, p.longitude, {D.addr_quality('p.address')} AS addr, {D.road_first('p.address')} AS road, {D.name_quality('p.name')} AS nm,
                 coalesce(n.id, '') AS single,
                 least(length(p.address), 35) + CASE WHEN p.hours <> '' THEN 12 ELSE 0 END + CASE WHEN p.description <> '' THEN 12 ELSE 0 END + least(coalesce(f.c, 0) * 5, 20) AS comp
          FROM places_v p LEFT JOIN named n ON n.id = p.id LEFT JOIN (SELECT place_id, count(*) AS c FROM photos_v GROUP BY 1) f ON f.place_id = p.id),
    u AS (SELECT category, latitude, longitude, addr, road, nm, single, min(id) AS id, count(*) AS copies, max(comp) AS comp FROM x GROUP BY ALL),
    pr AS (SELECT a.id AS ai, b.id AS bi, a.category, a.copies AS ac, b.copies AS bc, {D.meters('a.latitude', 'a.longitude', 'b.latitude', 'b.longitude')} AS d,
                  a.addr = b.addr AS sa, a.road <> '' AND a.road = b.road AS sr,
                  a.nm <> '' AND b.nm <> '' AND (contains(a.nm, b.nm) OR contains(b.nm, a.nm)) AS rn, r.a IS NOT NULL AS reviewed, a.comp AS acomp, b.comp AS bcomp
           FROM u a JOIN u b ON a.category = b.category AND (a.id < b.id OR (a.id = b.id AND a.copies > 1))
           LEFT JOIN rev r ON r.a = a.id AND r.b = b.id)
    SELECT ai AS first_id, bi AS second_id, category, ac AS first_copies, bc AS second_copies, {D.rnd('d')} AS distance_m, sa AS same_address, sr AS same_road_number, rn AS related_name,
           NOT reviewed AND (sa OR (sr AND d <= 45) OR rn) AS likely_duplicate,
           CASE WHEN reviewed THEN 'verified_distinct' WHEN sa OR (sr AND d <= 45) OR rn THEN 'unresolved' ELSE 'different' END AS review_status,
           acomp AS first_completeness, bcomp AS second_completeness
    FROM pr WHERE d <= 60"""


@query("c2_nearby_pairs", uses="places_v photos_v", sql=C2_SQL)
def c2(t):
    return DUP.near_duplicate_audit(t("places_v"), t("photos_v"), reviewed_pairs(t))


# every Han character of the generated place and candidate names, mapped one by one to a Latin letter, so that the byte-wise
# edit distance of the check engine counts characters
_HAN = "前程新闸岳阳人民太湖共和长海瑞金石门殷行大学政府路机关党群书房第社区图馆街道少儿者食堂滨河公园绿地阅闲坊停车场无点邻里中心"
_ABC = "".join(chr(c) for c in range(97, 123)) + "".join(chr(c) for c in range(65, 91)) + "!#$%()*+-./:;<=>?@[]^_`{|}~"


def _sim(a, b):
    f = lambda x: f"translate({x}, '{_HAN}', '{_ABC[:len(_HAN)]}')"
    return f"CASE WHEN {a} = '' OR {b} = '' THEN 0e0 ELSE 1 - levenshtein({f(a)}, {f(b)}) / greatest(length({a}), length({b})) END"


EDGES = f"""
    x AS (SELECT id, category, latitude, longitude, {D.name_dedupe('name')} AS nm, {D.addr_dedupe('address')} AS addr, {D.street_last('address')} AS door, name LIKE '%少儿%' AS kids FROM places_v),
    u AS (SELECT category, latitude, longitude, nm, addr, door, kids, min(id) AS id, count(*) AS copies FROM x GROUP BY ALL),
    pr AS (SELECT a.id AS a, b.id AS b, a.copies AS a_copies, b.copies AS b_copies, a.category, a.nm AS an, b.nm AS bn, a.addr AS aa, b.addr AS ba, a.door AS ad, b.door AS bd,
                  {_sim('a.nm', 'b.nm')} AS s,
                  CASE WHEN a.latitude <> 0 AND a.longitude <> 0 AND b.latitude <> 0 AND b.longitude <> 0 THEN {D.meters('a.latitude', 'a.longitude', 'b.latitude', 'b.longitude')} END AS d
           FROM u a JOIN u b ON a.category = b.category AND (a.id < b.id OR (a.id = b.id AND a.copies > 1)) AND (a.kids = b.kids OR a.addr = b.addr)),
    edges AS (SELECT *, aa <> '' AND aa = ba AS same_address, CASE
        WHEN aa <> '' AND ba <> '' AND (aa = ba OR (least(length(aa), length(ba)) >= 6 AND (contains(aa, ba) OR contains(ba, aa)))) AND s >= 0.25 THEN 'same_address_related_name'
        WHEN an = bn AND ad <> '' AND ad = bd THEN 'same_name_same_door' WHEN an = bn AND d <= CASE WHEN category = '食堂' THEN 80 ELSE 250 END THEN 'same_name_near'
        WHEN s >= 0.9 AND d <= 120 THEN 'very_similar_name_120m' WHEN s >= 0.82 AND d <= 60 THEN 'similar_name_60m'
        WHEN least(length(an), length(bn)) >= 4 AND (contains(an, bn) OR contains(bn, an)) AND d <= 80 THEN 'contained_name_80m' END AS rule FROM pr)"""


@query("c3_duplicate_edges", uses="places_v", sql=f"""
    WITH {EDGES} SELECT a, b, a_copies, b_copies, category, CAST(floor(s * 1000 + 0.5) AS BIGINT) AS similarity_milli, {D.rnd('d')} AS distance_m, same_address, rule
    FROM edges WHERE rule IS NOT NULL""")
def c3(t):
    units, _ = DUP.signatures(t("places_v"))
    return DUP.duplicate_edges(units)


@query("c4_radius_neighbours", uses="places_v", sql=f"""
    SELECT a.id AS target_id, b.id AS neighbour_id, {D.rnd(D.meters('a.latitude', 'a.longitude', 'b.latitude', 'b.longitude'))} AS distance_m
    FROM places_v a JOIN places_v b ON a.id <> b.id AND b.category IN ('图书馆', '自然') AND NOT ({dict(D.issue_list())['excluded_place_type'].replace('name', 'b.name')})
    WHERE {D.meters('a.latitude', 'a.longitude', 'b.latitude', 'b.longitude')} <= 2000""")
def c4(t):
    from placeloom.operators.select import by_categories

    cols = ["id", "latitude", "longitude"]
    met = near_pairs(t("places_v").select(*cols), by_categories(t("places_v"), ["图书馆", "自然"]).select(*cols), 2000.0, hot_rows=16 * HOT_CELL)
    return met.where("l_id <> r_id").select(F.col("l_id").alias("target_id"), F.col("r_id").alias("neighbour_id"), geo.js_round(F.col("distance")).alias("distance_m"))


@query("c5_nearest_place", uses="origins_v places_v", sql=f"""
    SELECT origin_id, arg_min(id, (d, id)) AS place_id, {D.rnd('min(d)')} AS distance_m FROM (
      SELECT o.origin_id, p.id, {D.meters('o.latitude', 'o.longitude', 'p.latitude', 'p.longitude')} AS d FROM origins_v o JOIN places_v p ON TRUE) GROUP BY 1""")
def c5(t):
    out = nearest(t("origins_v"), t("places_v"))
    return out.select("origin_id", "place_id", geo.js_round(F.col("distance")).alias("distance_m"))


def scored(t):
    p = t("places_v").select(F.col("id").alias("place_id"), "name", "category", "address", "latitude", "longitude")
    return M.score_candidates(skew_join(t("cands_v"), M.parse_places(p), ["place_id"]))


def _roads(x):
    """list of {road, n1, n2, lane} of an address."""
    base = D.rr(D.clean(x), (D.CITY, ""), (r"[，,。.、:：;；\\_—]", ""), ("临时服务点[:：]?", ""))
    part = lambda i: f"regexp_extract_all({base}, {D.q(D.ROAD)}, {i})"
    road = D.rr("z[1]", ("^.*?(?:区|县)", ""), ("^.*?(?:街道|镇|乡)", ""), ("公路$|大道$", "路"))
    zipped = f"list_zip({part(1)}, {part(2)}, {part(3)}, {part(4)})"
    return f"list_transform({zipped}, lambda z: {{'road': {road}, 'n1': z[2], 'n2': z[3], 'lane': z[4]}})"


SCORED = f"""
    raw AS (SELECT c.place_id, c.cand_no, c.kind, c.cand_name, c.cand_address, p.name, p.category, p.address, p.latitude, p.longitude, c.cand_latitude, c.cand_longitude,
        replace({D.district('p.address')}, '苏州高新区', '虎丘区') AS di, replace({D.district('c.cand_address')}, '苏州高新区', '虎丘区') AS dc,
        {_roads('p.address')} AS ri, {_roads('c.cand_address')} AS rc, {D.name_quality('p.name')} AS ni, {D.name_quality('c.cand_name')} AS nc,
        {D.addr_quality('p.address')} = {D.addr_quality('c.cand_address')} AS same_addr,
        {D.rnd(D.meters('p.latitude', 'p.longitude', 'c.cand_latitude', 'c.cand_longitude'))} AS mv
      FROM cands_v c JOIN places_v p ON p.id = c.place_id),
    fl AS (SELECT *, di = '' OR dc = '' OR di = dc AS dm, ni <> '' AND nc <> '' AND (contains(ni, nc) OR contains(nc, ni)) AS nmt,
        len(list_filter(ri, lambda x: len(list_filter(rc, lambda y: (x.road = y.road OR ends_with(x.road, y.road) OR ends_with(y.road, x.road))
            AND (x.n1 = y.n1 OR x.n1 = y.n2 OR (x.n2 <> '' AND (x.n2 = y.n1 OR x.n2 = y.n2)))
            AND (coalesce(x.lane, '') = '' OR coalesce(y.lane, '') = '' OR x.lane = y.lane))) > 0)) > 0 AS sm FROM raw),
    sc AS (SELECT *, CASE WHEN dm THEN 15 ELSE 0 END + CASE WHEN sm THEN 60 ELSE 0 END + CASE WHEN nmt THEN 25 ELSE 0 END + CASE WHEN NOT sm AND same_addr THEN 60 ELSE 0 END AS score FROM fl)"""


@query("c6_candidate_score", uses="cands_v places_v", sql=f"""
    WITH {SCORED} SELECT place_id, cand_no, score, dm AS district_match, sm AS street_number_match, nmt AS name_match, dm AND sm AND score >= 75 AS accepted, mv AS movement_m FROM sc""")
def c6(t):
    return scored(t).select("place_id", "cand_no", "score", "district_match", "street_number_match", "name_match", "accepted", "movement_m")


_SUZ = lambda x: D.rr(f"lower(coalesce({x}, ''))", ("上海市?|苏州市?|社区|街道|乡|镇|文化活动中心|文化中心|服务中心|分馆|馆", ""), (r"[^0-9a-z\x{4e00}-\x{9fff}]", ""))


@query("c6b_city_scorers", uses="cands_v places_v", sql=f"""
    WITH j AS (SELECT c.place_id, c.cand_no, p.name, p.address, c.cand_name, c.cand_address, {D.box('c.cand_latitude', 'c.cand_longitude', dims.CITY_BOXES['苏州'])} AS inside,
        {_SUZ('p.name')} AS a, {_SUZ('c.cand_name')} AS b,
        regexp_replace({D.clean('p.name')}, '[（）()\\-_·•]|一期|二期', '', 'g') AS na, regexp_replace({D.clean('c.cand_name')}, '[（）()\\-_·•]|一期|二期', '', 'g') AS nb,
        {D.district('p.address')} AS ds, {D.district('c.cand_address')} AS dm
      FROM cands_v c JOIN places_v p ON p.id = c.place_id),
    f AS (SELECT *, a <> '' AND b <> '' AND (contains(a, b) OR contains(b, a)) AS nm,
        len(list_filter(regexp_extract_all(address, {D.q(dims.STREET_TOKEN)}, 0), lambda x: contains(replace(cand_address, ' ', ''), x))) > 0 AS am,
        na <> '' AND nb <> '' AND (na = nb OR (length(na) >= 4 AND (contains(na, nb) OR contains(nb, na)))) AS same, ds = '' OR dm = '' OR ds = dm AS dok FROM j)
    SELECT place_id, cand_no, CASE WHEN nm THEN 45 ELSE 0 END + CASE WHEN am THEN 65 ELSE 0 END + CASE WHEN inside THEN 10 ELSE -100 END AS suzhou_score,
        CASE WHEN same THEN 70 ELSE 0 END + CASE WHEN dok THEN 20 ELSE 0 END + CASE WHEN cand_address <> '' THEN 10 ELSE 0 END AS nature_score,
        inside AND cand_address <> '' AND ((same AND dok) OR (cand_no = 2 AND address <> '' AND dok)) AS nature_accepted FROM f""")
def c6b(t):
    p = t("places_v").select(F.col("id").alias("place_id"), "name", "address")
    j = t("cands_v").join(p, "place_id")
    inside = geo.in_box("cand_latitude", "cand_longitude", dims.CITY_BOXES["苏州"])
    s = M.score_suzhou("name", "address", "cand_name", "cand_address", inside)
    n = M.score_nature("name", "address", F.lit(""), "cand_name", "cand_address", inside, F.col("cand_no") == 2)
    return j.select("place_id", "cand_no", s["score"].alias("suzhou_score"), n["score"].alias("nature_score"), n["accepted"].alias("nature_accepted"))


_NEW = lambda x: D.rr(f"lower({D.clean(x)})", ("嘉兴市?|南通市?|无锡市?|镇江市?|社区|街道|乡|镇|分馆|馆", ""), (r"[^0-9a-z\x{4e00}-\x{9fff}]", ""))
_LET = lambda x: f"array_to_string(list_sort(string_split(replace({x}, '点', ''), '')), '')"


def _city_roads(x):
    part = lambda i: f"regexp_extract_all({D.clean(x)}, {D.q(dims.ROAD_NUMBER_NEW_CITY)}, {i})"
    road = D.rr("z[1]", ("^.*(?:省|市|区|县|街道|镇|乡)", ""), ("大道", "路"), ("公路", "路"))
    return f"list_transform(list_zip({part(1)}, {part(2)}), lambda z: {{'r': {road}, 'n': z[2]}})"


@query("c6c_new_city_scorer", uses="cands_v places_v", sql=f"""
    WITH j AS (SELECT c.place_id, c.cand_no, c.cand_address, {D.box('c.cand_latitude', 'c.cand_longitude', dims.CITY_BOXES['嘉兴'])} AS inside, {_NEW('p.name')} AS a, {_NEW('c.cand_name')} AS b,
        {D.district('p.address')} AS di, {D.district('c.cand_address')} AS dc, {_city_roads('p.address')} AS ri,
        {_city_roads("CASE WHEN c.cand_address <> '' THEN c.cand_address ELSE c.cand_name END")} AS rc FROM cands_v c JOIN places_v p ON p.id = c.place_id),
    f AS (SELECT *, a <> '' AND b <> '' AND (contains(a, b) OR contains(b, a)) AS nm, a <> '' AND b <> '' AND (a = b OR (length({_LET('a')}) >= 5 AND {_LET('a')} = {_LET('b')})) AS ex,
        di = '' OR dc = '' OR di = dc AS dok,
        len(list_filter(ri, lambda x: len(list_filter(rc, lambda y: x.n = y.n AND (ends_with(x.r, y.r) OR ends_with(y.r, x.r)))) > 0)) > 0 AS rd FROM j)
    SELECT place_id, cand_no, CASE WHEN nm THEN 25 ELSE 0 END + CASE WHEN dok THEN 15 ELSE 0 END + CASE WHEN rd THEN 60 ELSE 0 END + CASE WHEN ex AND dc <> '' AND cand_address <> '' THEN 75 ELSE 0 END AS score,
        rd AS street_number_match, ex AS exact_name_match, inside AND dok AND (rd OR (ex AND dc <> '' AND cand_address <> '')) AS accepted FROM f""")
def c6c(t):
    j = t("cands_v").join(t("places_v").select(F.col("id").alias("place_id"), "name", "address"), "place_id")
    s = M.score_new_city("name", "address", "cand_name", "cand_address", geo.in_box("cand_latitude", "cand_longitude", dims.CITY_BOXES["嘉兴"]))
    return j.select("place_id", "cand_no", *[s[k].alias(k) for k in ("score", "street_number_match", "exact_name_match", "accepted")])


VERDICT = f"""{SCORED},
    v AS (SELECT *, CASE WHEN ni = '' OR nc = '' OR {D.like('cand_name', dims.SUBORDINATE_POI)} THEN 0 WHEN ni = nc THEN 2
          WHEN length(ni) >= 4 AND length(nc) >= 4 AND (contains(ni, nc) OR contains(nc, ni)) THEN 1 ELSE 0 END AS rel,
          {D.district('address')} = '' OR {D.district('cand_address')} = '' OR {D.district('address')} = {D.district('cand_address')} AS dok FROM sc),
    ad AS (SELECT * FROM v WHERE kind = 'address' AND dm AND sm AND score >= 75 QUALIFY row_number() OVER (PARTITION BY place_id ORDER BY score DESC, mv, cand_no) = 1),
    po AS (SELECT * FROM v WHERE kind = 'poi' AND rel > 0 AND dok AND mv <= 600 QUALIFY row_number() OVER (PARTITION BY place_id ORDER BY rel DESC, mv, cand_no) = 1),
    ne AS (SELECT * FROM v WHERE kind = 'address' AND nmt AND mv <= 120 AND {D.road_first('address')} = '' QUALIFY row_number() OVER (PARTITION BY place_id ORDER BY cand_no) = 1),
    verdict AS (SELECT p.id AS place_id, CASE WHEN ad.place_id IS NOT NULL THEN 'verified_address' WHEN po.place_id IS NOT NULL OR ne.place_id IS NOT NULL THEN 'verified_poi' ELSE 'unverified' END AS status,
        coalesce(ad.cand_no, po.cand_no, ne.cand_no) AS cand_no, coalesce(ad.mv, po.mv, ne.mv) AS movement_m
      FROM places_v p LEFT JOIN ad ON ad.place_id = p.id LEFT JOIN po ON po.place_id = p.id LEFT JOIN ne ON ne.place_id = p.id)"""


@query("c7_best_candidate", uses="cands_v places_v", sql=f"WITH {VERDICT} SELECT * FROM verdict")
def c7(t):
    return M.best_candidates(scored(t))


def _c8(name, cond, cat=True):
    def sql():
        return f"""
        WITH p AS (SELECT * FROM places_v WHERE k % 3 = 0), c AS (SELECT * FROM places_v WHERE k % 3 <> 0)
        SELECT c.id AS cand_id, min(p.id) AS place_id FROM c JOIN p ON c.category = p.category AND ({cond}) GROUP BY 1"""

    @query(f"c8_existing_{name}", uses="places_v", sql=sql())
    def run(t):
        p = t("places_v")
        return M.match_existing(p.where("k % 3 <> 0").withColumnRenamed("id", "cand_id"), p.where("k % 3 = 0"), name)


_NRD = lambda x: (lambda b: "(" + " || ".join(f"regexp_extract({b}, '([^区县0-9]{{1,30}}(?:公路|大道|路|街|道|弄|巷|村))([0-9]+)(?:弄([0-9]+))?号?', {i})" for i in (1, 2, 3)) + ")")(
    D.rr(D.clean(x), ("^上海市?", ""), (r"[（）()，,。.、:：;；/\\_\-—]", ""), (r"[一二三四五六七八九十0-9]+楼.*$", "")))
_MET = D.meters("c.latitude", "c.longitude", "p.latitude", "p.longitude")
_NT = D.name_notes
_c8("door_or_name_district", f"""({_NRD('p.address')} <> '' AND {_NRD('p.address')} = {_NRD('c.address')}) OR ({_NT('p.name')} <> '' AND {_NT('c.name')} <> ''
    AND (contains({_NT('p.name')}, {_NT('c.name')}) OR contains({_NT('c.name')}, {_NT('p.name')})) AND {D.district('p.address')} = {D.district('c.address')})""")
_c8("name_address_60m", f"""({D.name_quality('c.name')} <> '' AND {D.name_quality('c.name')} = {D.name_quality('p.name')}) OR ({D.addr_quality('c.address')} <> '' AND {D.addr_quality('c.address')} = {D.addr_quality('p.address')}) OR {_MET} < 60""")
_c8("address_name_contained", f"""({D.addr_dedupe('c.address')} <> '' AND {D.addr_dedupe('c.address')} = {D.addr_dedupe('p.address')}) OR ({D.name_dedupe('c.name')} <> '' AND {D.name_dedupe('c.name')} = {D.name_dedupe('p.name')})
    OR (least(length({D.name_dedupe('c.name')}), length({D.name_dedupe('p.name')})) >= 6 AND (contains({D.name_dedupe('c.name')}, {D.name_dedupe('p.name')}) OR contains({D.name_dedupe('p.name')}, {D.name_dedupe('c.name')})) AND {_MET} <= 150)""")
_c8("exact_name_or_address", "(c.name <> '' AND c.name = p.name) OR (c.address <> '' AND c.address = p.address)")
_c8("name_40m", f"{D.name_quality('c.name')} = {D.name_quality('p.name')} AND {_MET} < 40")


FP = """concat_ws(chr(31), name, category, printf('%.7f', latitude), printf('%.7f', longitude), address, hours, description, CAST(n AS STRING), CAST(dg AS STRING))"""
PRINTS = f"""pos AS (SELECT place_id, url, row_number() OVER (PARTITION BY place_id ORDER BY sort_order, photo_id) AS pos FROM photos_v),
    dg AS (SELECT place_id, count(*) AS n, CAST(sum(CAST(('0x' || substr(sha256(pos || '|' || url), 1, 15)) AS BIGINT)) AS HUGEINT) AS dg FROM pos GROUP BY 1),
    fp AS (SELECT id, k, sha256({FP}) AS fingerprint FROM (SELECT p.*, coalesce(d.n, 0) AS n, coalesce(d.dg, 0) AS dg FROM places_v p LEFT JOIN dg d ON d.place_id = p.id))"""
MIRROR = "mir AS (SELECT CASE WHEN k % 20 = 5 THEN 'x' || id ELSE id END AS id, CASE WHEN k % 10 = 7 THEN 'old' ELSE fingerprint END AS pushed FROM fp WHERE k % 20 <> 3)"


def mirror_of(fp):
    return fp.where("k % 20 <> 3").select(
        F.when(F.col("k") % 20 == 5, F.concat(F.lit("x"), "id")).otherwise(F.col("id")).alias("id"),
        F.when(F.col("k") % 10 == 7, "old").otherwise(F.col("fingerprint")).alias("pushed_fingerprint"))


@query("c9_mirror_diff", uses="places_v photos_v", sql=f"""
    WITH {PRINTS}, {MIRROR} SELECT coalesce(f.id, m.id) AS id, CASE WHEN f.id IS NULL THEN 'stale' WHEN m.id IS NULL THEN 'push_missing' ELSE 'push_changed' END AS action
    FROM fp f FULL JOIN mir m ON m.id = f.id WHERE f.id IS NULL OR m.id IS NULL OR f.fingerprint <> m.pushed""")
def c9(t):
    fp = sync.with_fingerprint(t("places_v"), t("photos_v"))
    return sync.publish_diff(fp, mirror_of(fp))


@query("c10_alias_lookup", uses="visits_v aliases_v", sql=f"WITH {FLAT} SELECT id, visitor_code, visitor_name FROM flat")
def c10(t):
    return visit_rows(t).select("id", "visitor_code", "visitor_name")


# pages carry their archive flags in simple keys of the page number; images refer to a page with another spelling of its url
@query("c11_provenance", sql="""
    WITH img AS (SELECT o_orderkey AS image_id, o_orderkey % (SELECT count(*) FROM pages) AS pg FROM orders)
    SELECT i.image_id, CASE WHEN p.page_id % 7 <> 0 AND i.image_id % 5 <> 0 THEN 'selected' ELSE 'rejected' END AS verdict FROM img i JOIN pages p ON p.page_id = i.pg""")
def c11(t):
    pages = t("pages").select("page_id", "url")
    n = pages.count()
    src = lambda c: F.concat(F.lit("https://img.example.com/"), c.cast("string"), F.lit(".jpg"))
    images = t("orders").select("o_orderkey", (F.col("o_orderkey") % n).alias("page_id")).join(pages, "page_id").select(
        F.col("o_orderkey").alias("image_id"), "page_id", "url", src(F.col("o_orderkey")).alias("source_url"),
        F.concat(F.regexp_replace("url", "#.*$", ""), F.lit("#frag")).alias("source_page"))
    # what the page archive says about its images; an image's own page decides, also where other pages have its url
    archive = images.select(
        F.col("url").alias("requested_url"), (F.col("page_id") % 7 != 0).alias("success"), F.col("source_url").alias("seen_url"),
        (F.col("image_id") % 5 != 0).alias("name_found"))
    return M.confirm_provenance(images, archive)


@query("c12_decision_carry_over", uses="photos_v", sql="""
    WITH src AS (SELECT place_id, url, photo_id, row_number() OVER (ORDER BY photo_id) AS n FROM photos_v),
    tgt AS (SELECT place_id, url, row_number() OVER (ORDER BY photo_id DESC) AS n FROM photos_v WHERE o % 4 <> 0),
    last AS (SELECT place_id, url, max(n) AS n FROM tgt GROUP BY 1, 2)
    SELECT s.n AS source_no, l.n AS target_no, s.n % 9 = 0 AS rejected FROM src s JOIN last l USING (place_id, url) WHERE s.n <= (SELECT count(*) FROM photos_v) - 100""")
def c12(t):
    """Decisions on the first numbers of one manifest, found again under the numbers of a reversed one."""
    p = t("photos_v").select("photo_id", "place_id", "url", "o")
    total = p.count()
    return M.carry_over(p, p.where("o % 4 <> 0"), [F.asc("photo_id")], [F.desc("photo_id")], total - 100, F.col("source_no") % 9 == 0)


@query("c13_redirects", uses="links_v", sql="""
    WITH res AS (SELECT DISTINCT raw_url, lp FROM links_v WHERE lp % 6 <> 2)
    SELECT l.place_id, l.lo, l.position, l.lp, regexp_replace(regexp_replace(l.raw_url, 'utm_source=x&', ''), '[?]$', '') AS url
    FROM links_v l JOIN res r ON r.raw_url = l.raw_url AND r.lp = l.lp WHERE l.raw_url NOT LIKE 'https://map.baidu.com/%'""")
def c13(t):
    links = t("links_v")
    res = links.where("lp % 6 <> 2").select("raw_url", "lp").distinct().withColumn("resolved", F.col("raw_url"))
    return M.resolve_redirects(links, res, ["raw_url", "lp"]).select("place_id", "lo", "position", "lp", "url")


@query("c14_url_agreement", sql="""
    SELECT page_id % 5 <> 0 AND page_id % 7 <> 0 AS agrees, count(*) AS pages FROM pages GROUP BY 1""")
def c14(t):
    """The answer URL differs in spelling only, except for every fifth (path) and every seventh (query) page."""
    base = F.regexp_replace(F.col("url"), "[?#].*$", "")
    req = F.concat(base, F.lit("?b=2&a=1&a=0"))
    res = F.concat(
        F.regexp_replace(base, "/*$", ""), F.when(F.col("page_id") % 5 == 0, "/other").otherwise(""),
        F.lit("/?a=0&b=2&a="), F.when(F.col("page_id") % 7 == 0, "3").otherwise("1"))
    same = K.request_key(req) == K.request_key(res)
    return t("pages").groupBy(same.alias("agrees")).agg(F.count(F.lit(1)).alias("pages"))


@query("c15_nearby_poi", uses="visits_v aliases_v", sql=f"WITH {FLAT} SELECT id, place_name FROM flat WHERE place_name <> ''")
def c15(t):
    p = F.from_json("payload", V.GEOCODE_SCHEMA)
    v = t("visits_v").where("latitude is not null").select("id", F.when(p["status"] == 0, p["result"]["pois"]).alias("pois"))
    return v.select("id", V.nearby_poi(F.col("pois")).alias("place_name")).where("place_name <> ''")


C16_D = D.meters("latitude", "longitude", "nlat", "nlon")


@query("c16_position_reconcile", uses="places_v", sql=f"""
    WITH a AS (SELECT id, latitude, longitude, CASE WHEN k % 9 = 0 THEN 'not_found' ELSE 'located' END AS status, k % 6 = 1 AS poi,
        CASE WHEN k % 6 = 1 THEN latitude + (k % 5) * 0.00005e0 ELSE latitude + (k % 8) * 0.001e0 END AS nlat, longitude AS nlon FROM places_v WHERE k % 25 <> 1),
    d AS (SELECT *, {C16_D} AS d FROM a)
    SELECT id, CASE WHEN poi THEN CASE WHEN d >= 10 THEN 'move' ELSE 'keep' END WHEN status <> 'located' THEN 'review' WHEN d > 500 THEN 'review' WHEN d >= 10 THEN 'move' ELSE 'keep' END AS action,
        CASE WHEN poi THEN 'second_pass_poi' WHEN status <> 'located' THEN status WHEN d > 500 THEN 'moved_over_500m' ELSE 'located_within_500m' END AS reason, {D.rnd('d')} AS movement_m FROM d""")
def c16(t):
    p = t("places_v").where("k % 25 <> 1")
    poi = F.col("k") % 6 == 1
    audit = p.select(
        "id", F.when(F.col("k") % 9 == 0, "not_found").otherwise("located").alias("status"),
        (F.col("latitude") + (F.col("k") % 8) * 0.001).alias("map_latitude"), F.col("longitude").alias("map_longitude"),
        F.when(poi, F.col("latitude") + (F.col("k") % 5) * 0.00005).alias("poi_latitude"), F.when(poi, F.col("longitude")).alias("poi_longitude"))
    return M.reconcile_positions(audit, t("places_v"))


@query("c18_mentions", sql=f"""
    WITH a AS (SELECT item_id, {D.alnum("split_part(text, '.', 1)")} AS alias FROM benchmark), d AS (SELECT doc_id, {D.alnum('text')} AS k FROM documents)
    SELECT d.doc_id AS page_id, a.item_id AS place_id FROM d JOIN a ON length(a.alias) >= 4 AND contains(d.k, a.alias)""")
def c18(t):
    """Which documents mention the first sentence of which benchmark item."""
    aliases = t("benchmark").select(F.col("item_id").alias("place_id"), T.alnum_key(F.split_part("text", F.lit("."), F.lit(1))).alias("alias"))
    return EV.mentions(t("documents").select(F.col("doc_id").alias("page_id"), T.alnum_key("text").alias("key")), aliases)


@query("c19_refresh_from_list", uses="places_v", sql="""
    WITH p AS (SELECT *, regexp_extract(name, '（(.+?)）', 1) || '|' || g AS bk FROM places_v),
    s AS (SELECT bk, max(CASE WHEN k % 4 = 0 THEN '周一闭馆' ELSE hours END) AS hours, max(address) AS address FROM p WHERE k % 7 <> 0 GROUP BY 1),
    o AS (SELECT bk, '人工时段' AS hours, CAST(NULL AS STRING) AS address FROM p WHERE k % 50 = 1 GROUP BY 1),
    j AS (SELECT p.id, p.bk, coalesce(o.hours, s.hours, p.hours) AS nh, coalesce(o.address, s.address, p.address) AS na, p.hours, p.address, s.bk IS NULL AND o.bk IS NULL AS missing
          FROM p LEFT JOIN s ON s.bk = p.bk LEFT JOIN o ON o.bk = p.bk)
    SELECT id, bk AS branch_key, nh AS new_hours, na AS new_address, concat_ws(',', CASE WHEN nh <> hours THEN 'hours' END, CASE WHEN na <> address THEN 'address' END) AS changed, missing AS source_missing
    FROM j WHERE missing OR nh <> hours OR na <> address""")
def c19(t):
    p = t("places_v").withColumn("branch_key", F.concat_ws("|", F.regexp_extract("name", "（(.+?)）", 1), F.col("g").cast("string")))
    src = p.where("k % 7 <> 0").groupBy("branch_key").agg(
        F.max(F.when(F.col("k") % 4 == 0, "周一闭馆").otherwise(F.col("hours"))).alias("hours"), F.max("address").alias("address"))
    over = p.where("k % 50 = 1").select("branch_key").distinct().withColumn("hours", F.lit("人工时段")).withColumn("address", F.lit(None).cast("string"))
    return sync.refresh_from_list(p, src, over, "branch_key", ["hours", "address"])
