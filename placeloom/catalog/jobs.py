"""Section K: composite jobs, and C17 which needs their parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from placeloom import dims
from placeloom.catalog import duck as D
from placeloom.catalog.aggregates import DUP_KEY, ISSUES, RICH
from placeloom.catalog.functions import _AISS, _repair, _terms
from placeloom.catalog.joins import MIRROR, PRINTS, SCORED, VERDICT, mirror_of, scored
from placeloom.catalog.ranking import gallery_input
from placeloom.catalog.registry import query
from placeloom.catalog.tables import FIELDS
from placeloom.functions import text as T
from placeloom.operators import matching as M, sync
from placeloom.plans import jobs as J
from placeloom.session import cut_lineage


def _address_points(x):
    return (f"(CASE WHEN {D.like(x, dims.CITY_START)} THEN 2 ELSE 0 END + CASE WHEN {D.district(x)} <> '' THEN 2 ELSE 0 END + CASE WHEN {D.like(x, dims.ADDRESS_PLACE)} THEN 2 ELSE 0 END"
            f" + CASE WHEN {D.like(x, r'[0-9]+(?:[—–-][0-9]+)?号')} THEN 8 ELSE 0 END + CASE WHEN {D.like(x, '交叉口|交汇处|路口|交界处')} THEN 5 ELSE 0 END"
            f" + CASE WHEN {D.like(x, '[东西南北](?:侧|角|约|[0-9])')} THEN 2 ELSE 0 END)")


def _issue_count(x):
    return "(" + " + ".join(f"CASE WHEN {c.replace('address', x)} THEN 1 ELSE 0 END" for _, c in _AISS) + ")"


@query("c17_address_reconcile", uses="cands_v places_v", sql=f"""
    WITH {VERDICT}, a AS (SELECT p.id, p.k, p.address, p.latitude, p.longitude, t.status, c.cand_address, c.cand_latitude AS cl, c.cand_longitude AS co, coalesce(s.rel, 0) AS rel, coalesce(s.dm AND s.sm AND s.score >= 75, FALSE) AS acc
        FROM places_v p JOIN verdict t ON t.place_id = p.id LEFT JOIN cands_v c ON c.place_id = p.id AND c.cand_no = t.cand_no LEFT JOIN v s ON s.place_id = p.id AND s.cand_no = t.cand_no),
    r AS (SELECT *, {_repair('address')} AS own, {_repair('cand_address')} AS cand, {D.meters('latitude', 'longitude', 'cl', 'co')} AS moved FROM a),
    z AS (SELECT *, {_issue_count('own')} AS n1, {_issue_count('cand')} AS n2, {_address_points('own')} AS s1, {_address_points('cand')} AS s2, status = 'verified_poi' AND rel = 2 AS xp,
        cand_address IS NOT NULL AND ({D.district('own')} = '' OR {D.district('cand')} = '' OR {D.district('own')} = {D.district('cand')}) AND ((status = 'verified_poi' AND rel = 2) OR (status = 'verified_address' AND acc)) AS trusted FROM r),
    y AS (SELECT *, trusted AND n2 = 0 AND (s2 > s1 - 8 * n1 OR n1 > 0) AS better, trusted AND moved >= 10 AND moved <= CASE WHEN xp THEN 1500 ELSE 500 END AS shift FROM z)
    SELECT id, status, CASE WHEN k % 40 = 1 THEN '上海市徐汇区人民路1号' WHEN better THEN cand ELSE own END AS address,
       CASE WHEN k % 40 = 1 THEN 'manual' WHEN better OR shift THEN CASE WHEN xp THEN 'same_name_poi' ELSE 'address_match' END WHEN own <> address THEN 'address_repair' ELSE '' END AS source,
       round(CASE WHEN k % 40 <> 1 AND shift THEN cl ELSE latitude END, 6) AS latitude FROM y""")
def c17(t):
    out = reconcile(t)
    return out.select("id", "status", "address", "source", F.round("latitude", 6).alias("latitude"))


def reconcile(t):
    s = scored(t).select(
        "place_id", "cand_no", "kind", "cand_name", "cand_address", "cand_latitude", "cand_longitude", "address", "_ni", "_nc", "score", "accepted", "movement_m")
    s = cut_lineage(s)  # the verdict and its details both read the scores
    verdict = M.best_candidates(s)
    rel = M.name_relation(F.col("_ni"), F.col("_nc"), F.col("cand_name"))
    detail = s.select("place_id", "cand_no", "cand_address", "cand_latitude", "cand_longitude", rel.alias("name_relation"), "accepted")
    audit = verdict.join(detail, ["place_id", "cand_no"], "left").withColumnRenamed("place_id", "id").drop("cand_no", "movement_m")
    over = t("places_v").where("k % 40 = 1").select(
        "id", F.lit("上海市徐汇区人民路1号").alias("o_address"), F.lit(None).cast("double").alias("o_latitude"), F.lit(None).cast("double").alias("o_longitude"))
    return M.reconcile_addresses(audit.drop("address"), over, t("places_v"))


@query("c17_city_pass", uses="cands_v places_v", sql=f"""
    WITH {VERDICT}, a AS (SELECT p.id, p.name, v.status, v.movement_m, coalesce(c.cand_name, '') AS cn, coalesce(c.cand_address, '') AS ca FROM places_v p JOIN verdict v ON v.place_id = p.id LEFT JOIN cands_v c ON c.place_id = p.id AND c.cand_no = v.cand_no),
    k AS (SELECT *, regexp_replace(regexp_replace(regexp_replace(name, '^(?:上海市?|苏州市?)', ''), '[（）()·\\s]', '', 'g'), '(?:北门|南门|东门|西门|入口)$', '') AS pn, regexp_replace(regexp_replace(regexp_replace(cn, '^(?:上海市?|苏州市?)', ''), '[（）()·\\s]', '', 'g'), '(?:北门|南门|东门|西门|入口)$', '') AS cnn FROM a)
    SELECT id, CASE WHEN status NOT IN ('verified_poi', 'verified_address') THEN 'no_verified_map_poi' WHEN NOT CASE WHEN length(pn) <= 3 THEN pn = cnn ELSE contains(cnn, pn) OR contains(pn, cnn) END THEN 'candidate_name_mismatch'
      WHEN NOT (ca LIKE '上海市%' OR ca LIKE '苏州市%' OR ca LIKE '苏州高新区%') OR length(ca) > 80 OR NOT {D.like('ca', dims.PROBLEM_LOCATOR)} THEN 'address_not_specific' WHEN movement_m > 3000 THEN 'movement_over_3000m' ELSE '' END AS hold_reason FROM k""")
def c17b(t):
    v = M.best_candidates(scored(t)).join(t("cands_v").select("place_id", "cand_no", "cand_name", "cand_address"), ["place_id", "cand_no"], "left")
    j = t("places_v").select(F.col("id").alias("place_id"), "name").join(v, "place_id")
    return j.select(F.col("place_id").alias("id"), M.city_pass_reason("status", "name", "cand_name", "cand_address", "movement_m").alias("hold_reason"))


@query("k1_audit_places", uses="places_v", sql=f"""
    WITH f AS (SELECT id, category, unnest({ISSUES}) AS issue FROM places_v UNION ALL
      SELECT id, category, 'duplicate_place' FROM (SELECT *, row_number() OVER (PARTITION BY category, {DUP_KEY}, {D.addr_quality('address')} ORDER BY name, id) AS n FROM places_v) WHERE n > 1)
    SELECT id, issue FROM f""")
def k1(t):
    return J.audit_places(t("places_v"))[0].select("id", "issue")


@query("k1_audit_counts", uses="places_v", sql=f"""
    WITH f AS (SELECT id, category, unnest({ISSUES}) AS issue FROM places_v UNION ALL
      SELECT id, category, 'duplicate_place' FROM (SELECT *, row_number() OVER (PARTITION BY category, {DUP_KEY}, {D.addr_quality('address')} ORDER BY name, id) AS n FROM places_v) WHERE n > 1)
    SELECT category, issue, count(*) AS findings FROM f GROUP BY 1, 2""")
def k1c(t):
    return J.audit_places(t("places_v"))[1]


@query("k2_resolve_duplicates", uses="places_v photos_v", sql=f"""
    WITH RECURSIVE_MARK {RICH} SELECT r.id, c.canonical_id FROM rich r JOIN canon c USING (group_id) WHERE r.id <> c.canonical_id""")
def k2(t):
    return J.resolve_duplicates(t("places_v"), t("photos_v")).removed


@query("k3_verify_candidates", uses="cands_v places_v", sql=f"""
    WITH {SCORED}, best AS (SELECT * FROM sc WHERE dm AND sm AND score >= 75 QUALIFY row_number() OVER (PARTITION BY place_id ORDER BY score DESC, mv, cand_no) = 1),
    m AS (SELECT p.id, p.name, p.category, p.address, coalesce(b.cand_latitude, p.latitude) AS latitude, coalesce(b.cand_longitude, p.longitude) AS longitude, p.latitude AS lat0, p.longitude AS lon0, b.place_id AS bp
        FROM places_v p LEFT JOIN best b ON b.place_id = p.id),
    g AS (SELECT *, array_to_string({ISSUES}, ',') AS issues FROM m)
    SELECT id, CASE WHEN bp IS NULL THEN 'map' WHEN issues <> '' THEN 'audit' ELSE 'approved' END AS stage, CASE WHEN bp IS NULL THEN 'no_accepted_candidate' ELSE issues END AS reason,
      CASE WHEN bp IS NULL OR issues <> '' THEN 'delete' WHEN latitude <> lat0 OR longitude <> lon0 THEN 'update' END AS action,
      CASE WHEN bp IS NULL OR issues <> '' THEN '' WHEN latitude <> lat0 OR longitude <> lon0 THEN concat_ws(',', CASE WHEN latitude <> lat0 THEN 'latitude' END, CASE WHEN longitude <> lon0 THEN 'longitude' END) END AS changed FROM g""")
def k3(t):
    gate, actions = J.verify_candidates(t("places_v"), t("cands_v"), t("places_v"), FIELDS, duplicates=True)
    return gate.join(actions.select("id", "action", "changed"), "id", "left")


@query("k4_extract_evidence")
def k4(t):
    """Mentions of benchmark sentences in the documents as evidence lines, with a Latin term list."""
    return J.extract_evidence(evidence_pages(t), evidence_names(t), 80, ["the", "and", "der", "und", "le", "la", "en", "de"])


def evidence_pages(t):
    """Every third document is a search page (its lines must mention the place themselves), every seventh has a wrong URL."""
    url = F.concat(F.lit("https://"), "source", F.lit(".example.com/?q="), F.col("doc_id").cast("string"))
    return t("documents").select(
        F.col("doc_id").alias("page_id"), F.concat(F.lit("有"), "text").alias("text"), (F.col("doc_id") % 3 != 0).alias("is_source"), url.alias("requested_url"),
        F.when(F.col("doc_id") % 7 == 0, F.concat(url, F.lit("0"))).otherwise(url).alias("result_url"))


def evidence_names(t):
    return t("benchmark").select(F.concat(F.lit("b"), F.col("item_id").cast("string")).alias("id"), T.alnum_key(F.split_part("text", F.lit("."), F.lit(1))).alias("alias"))


@query("k5_curate_gallery")
def k5(t):
    feats = gallery_input(t).drop("blocked").join(t("photos_v").select("photo_id", "digest"), "photo_id")
    return J.curate_gallery(feats)


_U = "regexp_replace(raw_url, 'utm_source=x&', '')"


@query("k6_rank_sources", uses="links_v places_v", sql=f"""
    WITH l AS (SELECT l.place_id, {_U} AS url, l.position, l.lo, p.name, title AS t, regexp_extract(raw_url, '//([^/]*)', 1) AS h FROM links_v l JOIN places_v p ON p.id = l.place_id WHERE raw_url NOT LIKE 'https://map.baidu.com/%'),
    k AS (SELECT *, {D.alnum('t')} AS key, {D.alnum('name')} AS fn, {D.alnum("regexp_replace(name, '[（(].*?[）)]', '', 'g')")} AS bn FROM l),
    s AS (SELECT place_id, url, position, h, ({_terms('t', dims.FIELD_TERMS)}) * 9 + CASE WHEN fn <> '' AND contains(key, fn) THEN 90 WHEN contains(key, bn) THEN 30 ELSE 0 END
      + CASE WHEN ends_with(h, 'gov.cn') OR contains(h, '.gov.cn') THEN 100 ELSE 0 END + CASE WHEN contains(h, 'library') OR ends_with(h, 'sh.cn') THEN 70 ELSE 0 END
      + CASE WHEN {D.like('h', r'xiaohongshu|dianping|weibo|amap|map\.qq')} THEN 55 ELSE 0 END + CASE WHEN {D.like('h', r'thepaper|shobserver|xinmin|163\.com')} THEN 30 ELSE 0 END - position AS score FROM k),
    b AS (SELECT place_id, url, max(score) AS score, regexp_replace(any_value(h), '^www\\.', '') AS domain FROM s WHERE score >= 25 GROUP BY 1, 2),
    d AS (SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY place_id, domain ORDER BY score DESC, url) <= 2)
    SELECT place_id, url, score, row_number() OVER (PARTITION BY place_id ORDER BY score DESC, url) AS rank FROM d QUALIFY rank <= 6""")
def k6(t):
    names = t("places_v").select(F.col("id").alias("place_id"), "name")
    return J.rank_sources(t("links_v"), names).select("place_id", "url", "score", "rank")


@query("k7_publish_docs", uses="places_v photos_v", sql=f"""
    WITH {PRINTS}, {MIRROR} SELECT f.id, p.name, coalesce(a.n, 0) AS photos FROM fp f JOIN places_v p ON p.id = f.id LEFT JOIN mir m ON m.id = f.id LEFT JOIN dg a ON a.place_id = f.id
    WHERE m.id IS NULL OR f.fingerprint <> m.pushed""")
def k7(t):
    fp = sync.with_fingerprint(t("places_v"), t("photos_v"))
    docs = J.publish(t("places_v"), t("photos_v"), mirror_of(fp))[1]
    return docs.select("id", "name", F.size("photos").alias("photos"))


_EX = dict(D.issue_list())["excluded_place_type"]


@query("k8_viewport_query", uses="viewports_v places_v", sql=f"""
    WITH b AS (SELECT vid, south + (north - south) * least(0.45e0, bottom_ratio) AS south, north - (north - south) * least(0.45e0, top_ratio) AS north, west, east FROM viewports_v),
    j AS (SELECT b.vid, p.id, b.south, b.north, b.west, b.east, p.latitude, p.longitude, row_number() OVER (PARTITION BY vid ORDER BY p.id) - 1 AS p, count(*) OVER (PARTITION BY vid) AS m
      FROM b JOIN (SELECT * FROM places_v WHERE category IN ('图书馆', '自然') AND NOT ({_EX})) p ON p.latitude BETWEEN b.south AND b.north AND p.longitude BETWEEN b.west AND b.east)
    SELECT vid, id, {D.rnd(D.meters('(south + north) / 2', '(west + east) / 2', 'latitude', 'longitude'))} AS distance_m, m > 20 AS sampled FROM j
    WHERE m <= 20 OR p IN (SELECT CAST(floor(i * m / 20.0e0) AS BIGINT) FROM range(0, 20) r(i))""")
def k8(t):
    return J.viewport_query(t("viewports_v"), t("places_v"), ["图书馆", "自然"], 20)


@query("k8_default_place", uses="viewports_v places_v", sql=f"""
    WITH p AS (SELECT * FROM places_v WHERE category = '食堂' AND NOT ({_EX})),
    j AS (SELECT v.vid, p.id, {D.meters('(south + north) / 2', '(west + east) / 2', 'latitude', 'longitude')} AS d, latitude BETWEEN south AND north AND longitude BETWEEN west AND east AS inside FROM viewports_v v JOIN p ON TRUE)
    SELECT vid, arg_min(id, (NOT inside, d, id)) AS id, bool_or(inside) AS in_view FROM j GROUP BY 1""")
def k8b(t):
    return J.default_places(t("viewports_v"), t("places_v"), ["食堂"])
