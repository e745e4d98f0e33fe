"""Section H: column functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from placeloom import dims
from placeloom.catalog import duck as D
from placeloom.catalog.joins import FP, PRINTS, _HAN, _ABC, _sim, _roads, _NRD  # noqa: F401
from placeloom.catalog.ranking import BODY, _LINE, vision_features
from placeloom.catalog.registry import query
from placeloom.functions import geo, keys as K, text as T
from placeloom.operators import duplicates as DUP, evidence as EV, gallery as G, sync
from placeloom.operators.scale import skew_join
from placeloom.sources import files


@query("h1_clean_text", uses="places_v", sql=f"""
    WITH x AS (SELECT id, name || '&nbsp;' || chr(12288) || address || chr(160) || ' x' || chr(65279) AS v FROM places_v) SELECT id, {D.clean('v')} AS v FROM x""")
def h1(t):
    v = F.concat("name", F.lit("&nbsp;　"), "address", F.lit("  x﻿"))
    return t("places_v").select("id", T.clean_text(v).alias("v"))


_P = D.PUNCT


@query("h2_names", uses="places_v", sql=f"""
    SELECT id, {D.name_quality('name')} AS quality, {D.name_notes('name')} AS notes, {D.name_dedupe('name')} AS dedupe,
      {D.rr(f"lower({D.clean('name')})", (r"[（）()【】\[\]·•,，.。:：;；/\\_\-—&“”" + '"' + "'’]", ""))} AS compact,
      {D.rr(f"lower({D.clean('name')})", ('嘉兴市?|南通市?|无锡市?|镇江市?|社区|街道|乡|镇|分馆|馆', ''), (r'[^0-9a-z\x{4e00}-\x{9fff}]', ''))} AS new_city,
      {D.rr(D.clean('name'), (r'(?:苏州|南通|无锡|嘉兴|镇江)市?|国家级?|省级?|[（）()·•_\-—]', ''))} AS nature_map,
      {D.rr(D.clean('name'), (r'[（）()\-_·•]', ''), ('一期|二期', ''))} AS nature, {D.alnum('name')} AS alnum FROM places_v""")
def h2(t):
    profiles = ["quality", "notes", "dedupe", "compact", "new_city", "nature_map", "nature"]
    return t("places_v").select("id", *[T.normalize_name("name", p).alias(p) for p in profiles], T.alnum_key("name").alias("alnum"))


@query("h3_addresses", uses="places_v", sql=f"""
    SELECT id, {D.addr_quality('address')} AS quality, {D.addr_dedupe('address')} AS dedupe,
      {D.rr(D.clean('address'), ('^上海市?', ''), (r'[（）()，,。.、:：;；/\\_\-—]', ''), (r'[一二三四五六七八九十0-9]+楼.*$', ''))} AS notes FROM places_v""")
def h3(t):
    return t("places_v").select("id", *[T.normalize_address("address", p).alias(p) for p in ("quality", "dedupe", "notes")])


@query("h4_district", uses="places_v", sql=f"""
    SELECT id, {D.district('address')} AS district, replace({D.district('address')}, '苏州高新区', '虎丘区') AS canonical FROM places_v""")
def h4(t):
    return t("places_v").select("id", T.extract_district("address").alias("district"), T.canonical_district("address").alias("canonical"))


@query("h5_door_numbers", uses="places_v", sql=f"""
    SELECT id, array_to_string(list_transform({_roads('address')}, lambda r: r.road || '#' || r.n1 || CASE WHEN r.n2 <> '' THEN '+' || r.n2 ELSE '' END || CASE WHEN r.lane <> '' THEN '/' || r.lane ELSE '' END), ';') AS numbers,
      {D.road_first('address')} AS first_number FROM places_v""")
def h5(t):
    shown = F.transform(T.road_numbers("address"), lambda r: F.concat(
        r["road"], F.lit("#"), F.array_join(r["numbers"], "+"), F.when(r["lane"].isNotNull(), F.concat(F.lit("/"), r["lane"])).otherwise("")))
    return t("places_v").select("id", F.array_join(shown, ";").alias("numbers"), T.road_number("address").alias("first_number"))


@query("h6_street_number", uses="places_v", sql=f"SELECT id, {D.street_last('address')} AS street_number, {_NRD('address')} AS note_number FROM places_v")
def h6(t):
    return t("places_v").select("id", T.street_number("address").alias("street_number"), T.note_road_number("address").alias("note_number"))


@query("h7_similarity", uses="places_v cands_v", sql=f"""
    WITH j AS (SELECT c.place_id, c.cand_no, {D.name_dedupe('p.name')} AS a, {D.name_dedupe('c.cand_name')} AS b FROM cands_v c JOIN places_v p ON p.id = c.place_id)
    SELECT place_id, cand_no, CAST(floor(({_sim('a', 'b')}) * 1000 + 0.5) AS BIGINT) AS milli FROM j""")
def h7(t):
    j = t("cands_v").join(t("places_v").select(F.col("id").alias("place_id"), "name"), "place_id")
    return j.select("place_id", "cand_no", F.floor(T.similarity(T.dedupe_key("name"), T.dedupe_key("cand_name")) * 1000 + 0.5).alias("milli"))


def _gcj():
    x, y = "(longitude - 105e0)", "(latitude - 35e0)"
    w = lambda v, *ts: "(" + " + ".join(f"{a} * sin({v} * pi() * {m!r})" for a, m in ts) + ") * 2 / 3"
    rip = w(x, (20, 6), (20, 2))
    la = f"(-100 + 2 * {x} + 3 * {y} + 0.2e0 * {y} * {y} + 0.1e0 * {x} * {y} + 0.2e0 * sqrt(abs({x})) + {rip} + {w(y, (20, 1), (40, 1 / 3))} + {w(y, (160, 1 / 12), (320, 1 / 30))})"
    lo = f"(300 + {x} + 2 * {y} + 0.1e0 * {x} * {x} + 0.1e0 * {x} * {y} + 0.1e0 * sqrt(abs({x})) + {rip} + {w(x, (20, 1), (40, 1 / 3))} + {w(x, (150, 1 / 12), (300, 1 / 30))})"
    m = "(1 - 0.006693421622965943e0 * sin(radians(latitude)) * sin(radians(latitude)))"
    return (f"latitude + {la} * 180 / ((6378245e0 * (1 - 0.006693421622965943e0)) / ({m} * sqrt({m})) * pi())",
            f"longitude + {lo} * 180 / (6378245e0 / sqrt({m}) * cos(radians(latitude)) * pi())")


@query("h8_datum_shift", uses="places_v", sql=f"SELECT id, CAST(round(({_gcj()[0]}) * 1e6) AS BIGINT) AS lat_micro, CAST(round(({_gcj()[1]}) * 1e6) AS BIGINT) AS lon_micro FROM places_v")
def h8(t):
    la, lo = geo.wgs84_to_gcj02("latitude", "longitude")
    return t("places_v").select("id", F.round(la * 1e6).cast("bigint").alias("lat_micro"), F.round(lo * 1e6).cast("bigint").alias("lon_micro"))


def _repair(x):
    """RE2 has no look-around and no back-references: the generated addresses repeat only these two names."""
    a = D.rr(f"trim({x})", ("^中国", ""), ("^(?:江苏省|浙江省)(苏州市|无锡市|南通市|镇江市|嘉兴市)", r"\1"), (r"\s+", ""), ("^(.+?)上海市", r"\1"), ("^(.+?)苏州市", r"\1"),
             ("浦东新区浦东新区", "浦东新区"), (r"\((?:[^)]*(?:地铁站|步行|建设中|装修中)[^)]*)\)", ""), (r"[，,。；;]+$", ""))
    tail = "公园|景区|绿地|休闲苑|图书馆|酒店|大厦|学校|地铁站|内|楼|栋|室|[东西南北]侧|方向|靠近"
    return f"CASE WHEN {D.like(f'regexp_extract({a}, {D.q('号([^号]*)$')}, 1)', tail)} THEN regexp_replace({a}, '号[^号]*$', '号') ELSE {a} END"


@query("h9_address_repair", uses="places_v", sql=f"SELECT id, {_repair('address')} AS address FROM places_v")
def h9(t):
    return t("places_v").select("id", T.repair_address("address").alias("address"))


_AISS = [
    ("missing_city", f"NOT {D.like('address', dims.CITY_START)}"), ("missing_district", f"{D.district('address')} = ''"),
    ("missing_location_detail", f"NOT {D.like('address', dims.ADDRESS_PLACE)}"), ("description_text", D.like("address", dims.ADDRESS_PROSE)),
    ("too_long", "length(address) > 80"), ("repeated_division_suffix", D.like("address", "区区|市市|县县"))]


@query("h10_address_quality", uses="places_v", sql=f"""
    SELECT id, {D.code_list(_AISS)} AS issues, CASE WHEN {D.like('address', dims.CITY_START)} THEN 2 ELSE 0 END + CASE WHEN {D.district('address')} <> '' THEN 2 ELSE 0 END
      + CASE WHEN {D.like('address', dims.ADDRESS_PLACE)} THEN 2 ELSE 0 END + CASE WHEN {D.like('address', r'[0-9]+(?:[—–-][0-9]+)?号')} THEN 8 ELSE 0 END
      + CASE WHEN {D.like('address', '交叉口|交汇处|路口|交界处')} THEN 5 ELSE 0 END + CASE WHEN {D.like('address', '[东西南北](?:侧|角|约|[0-9])')} THEN 2 ELSE 0 END
      - 8 * ({' + '.join(f'CASE WHEN {c} THEN 1 ELSE 0 END' for _, c in _AISS)}) AS score FROM places_v""")
def h10(t):
    return t("places_v").select("id", F.array_join(T.address_issues("address"), ",").alias("issues"), T.address_score("address").alias("score"))


_LOC = "路|街|巷|弄|大道|公路|村|镇|乡|园|苑|湖|河|浜|港|桥|交叉口|口|旁|侧|段|沿线"


@query("h11_canonical_address", uses="pois_v", sql=f"""
    WITH a AS (SELECT id, city, CASE WHEN k % 3 = 0 THEN address WHEN k % 3 = 1 THEN '' ELSE district END AS m, CASE WHEN k % 5 = 0 THEN '' ELSE district || '人民路东侧' END AS h, district FROM pois_v),
    b AS (SELECT *, regexp_extract(concat_ws(' ', m, district, h), {D.q('|'.join(dims.DISTRICTS))}, 0) AS d FROM a)
    SELECT id, CASE WHEN starts_with(m, city) AND d <> '' AND regexp_matches(substr(m, length(city) + length(d) + 1), '{_LOC}') THEN m
      WHEN h <> '' THEN city || d || CASE WHEN d <> '' AND starts_with(h, d) THEN substr(h, length(d) + 1) ELSE h END WHEN starts_with(m, city) THEN m ELSE city || m END AS address FROM b""")
def h11(t):
    p = t("pois_v")
    m = F.when(F.col("k") % 3 == 0, F.col("address")).when(F.col("k") % 3 == 1, "").otherwise(F.col("district"))
    h = F.when(F.col("k") % 5 == 0, "").otherwise(F.concat("district", F.lit("人民路东侧")))
    return p.select("id", T.nature_address(F.col("city"), F.col("district"), m, h).alias("address"))


@query("h12_url_keys", sql=r"""
    WITH u AS (SELECT page_id, lower(regexp_extract(url, '^([^:/?#]+):', 1)) AS s, lower(regexp_extract(url, '^[^:/?#]+://([^/?#]*)', 1)) AS h, regexp_extract(url, '^[^:/?#]+://[^/?#]*([^?#]*)', 1) AS p, regexp_extract(url, '[?]([^#]*)', 1) AS q FROM pages),
    v AS (SELECT *, list_transform(list_filter(string_split(q, '&'), lambda x: x <> ''), lambda x: CASE WHEN contains(x, '=') THEN x ELSE x || '=' END) AS ps FROM u),
    w AS (SELECT *, array_to_string(list_sort(ps), '&') AS sq, array_to_string(list_filter(ps, lambda x: lower(split_part(x, '=', 1)) NOT IN ('src', 'timestamp', 'ver', 'signature', 'from', 'source', 'utm_source', 'utm_medium', 'utm_campaign', 'utm_content', 'utm_term')), '&') AS kq FROM v)
    SELECT page_id, s || '://' || h || rtrim(p, '/') || CASE WHEN sq <> '' THEN '?' || sq ELSE '' END AS canonical, s || '://' || h || p || CASE WHEN kq <> '' THEN '?' || kq ELSE '' END AS source,
      regexp_replace(h, '^www\.', '') AS domain, h = 'example.com' OR ends_with(h, '.example.com') AS below FROM w""")
def h12(t):
    return t("pages").select("page_id", K.canonical_url("url").alias("canonical"), K.source_url("url").alias("source"), K.bare_domain("url").alias("domain"), K.domain_in("url", ["example.com"]).alias("below"))


@query("h13_line_cleaning", sql=f"""
    WITH r AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS u, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS n FROM documents),
    l AS (SELECT doc_id, n, {_LINE} AS line FROM r), p AS (SELECT doc_id, n, unnest(string_split(regexp_replace(line, '([。！？!?；;])\\s*', '\\1' || chr(1), 'g'), chr(1))) AS piece FROM l)
    SELECT doc_id, count(*) AS sentences, md5(string_agg(trim(piece), '|' ORDER BY trim(piece))) AS digest FROM p WHERE trim(piece) <> '' GROUP BY 1""")
def h13(t):
    """Sentences of the cleaned lines per document; the digest is taken inside the row, over the document's own text."""
    lines = F.transform(F.split("text", "\n"), T.clean_markdown)
    pieces = F.array_sort(F.flatten(F.transform(lines, T.sentences)))
    d = t("documents").select("doc_id", pieces.alias("p"))
    return d.where(F.size("p") > 0).select("doc_id", F.size("p").cast("bigint").alias("sentences"), F.md5(F.array_join("p", "|")).alias("digest"))


@query("h14_fingerprint", uses="places_v photos_v", sql=f"WITH {PRINTS} SELECT id, fingerprint FROM fp")
def h14(t):
    return sync.with_fingerprint(t("places_v"), t("photos_v")).select("id", "fingerprint")


@query("h15_stable_ids", uses="places_v visits_v", sql="""
    SELECT id AS source, 'city-' || substr(sha256(category || '|' || name || '|' || address), 1, 24) AS stable_id FROM places_v
    UNION ALL SELECT id, upper(substr(sha256('miniprogram:' || openid), 1, 6)) FROM visits_v""")
def h15(t):
    a = t("places_v").select(F.col("id").alias("source"), K.stable_id("city", "category", "name", "address").alias("stable_id"))
    b = t("visits_v").select(F.col("id").alias("source"), K.visitor_code(K.visitor_id("openid", F.lit(""))).alias("stable_id"))
    return a.unionByName(b)


def _terms(x, terms):
    return " + ".join(f"CASE WHEN contains(lower({x}), '{w}') THEN 1 ELSE 0 END" for w in terms)


@query("h16_source_scores", uses="links_v places_v", sql=f"""
    WITH l AS (SELECT l.*, p.name, regexp_extract(raw_url, '//([^/]*)', 1) AS h, CASE WHEN l.lp % 5 = 0 THEN p.name ELSE '' END || ' ' || title AS t FROM links_v l JOIN places_v p ON p.id = l.place_id),
    k AS (SELECT *, {D.alnum('t')} AS key, {D.alnum('name')} AS fn, {D.alnum("regexp_replace(name, '[（(].*?[）)]', '', 'g')")} AS bn FROM l)
    SELECT place_id, lo, position, lp, ({_terms('t', dims.FIELD_TERMS)}) * 9 + CASE WHEN fn <> '' AND contains(key, fn) THEN 90 WHEN contains(key, bn) THEN 30 ELSE 0 END
      + CASE WHEN ends_with(h, 'gov.cn') OR contains(h, '.gov.cn') THEN 100 ELSE 0 END + CASE WHEN contains(h, 'library') OR ends_with(h, 'sh.cn') THEN 70 ELSE 0 END
      + CASE WHEN {D.like('h', r'xiaohongshu|dianping|weibo|amap|map\.qq')} THEN 55 ELSE 0 END + CASE WHEN {D.like('h', r'thepaper|shobserver|xinmin|163\.com')} THEN 30 ELSE 0 END - CASE WHEN key = '' THEN 80 ELSE 0 END AS score,
      ({_terms('title', dims.FACILITY_TERMS)}) * 8 + CASE WHEN ends_with(h, 'gov.cn') OR contains(h, 'library') THEN 80 ELSE 0 END + CASE WHEN channel IN ('小红书', '大众点评') THEN 45 ELSE 0 END
      + CASE WHEN {D.like('title', '官方|服务')} THEN 25 ELSE 0 END - position AS facility_score FROM k""")
def h16(t):
    names = t("places_v").select(F.col("id").alias("place_id"), "name")
    lead = F.when(F.col("lp") % 5 == 0, F.col("name")).otherwise("")
    return EV.with_source_score(t("links_v").withColumn("host", K.url_host("raw_url")), names, lead, "title").select(
        "place_id", "lo", "position", "lp", "score",
        EV.facility_source_score("raw_url", F.col("host"), F.col("channel"), "title", F.lit(""), "position", dims.FACILITY_TERMS).alias("facility_score"))


@query("h16_note_scores", uses="notes_v", sql=f"""
    WITH {BODY}, s AS (SELECT *, {D.name_notes('title')} AS nt FROM ms)
    SELECT note_id, match_score, trim(body) <> '' AND match_score >= 80 AS accepted,
      CASE WHEN contains(title, place_name) THEN 120 ELSE 0 END + CASE WHEN np <> '' AND np = nt THEN 100 ELSE 0 END + CASE WHEN least(length(np), length(nt)) >= 3 AND (contains(np, nt) OR contains(nt, np)) THEN 70 ELSE 0 END
      + CASE WHEN category = '图书馆' AND regexp_matches(title, '图书馆|阅读空间') THEN 15 ELSE 0 END + CASE WHEN category = '食堂' AND regexp_matches(title, '食堂|助餐') THEN 15 ELSE 0 END AS title_score FROM s""")
def h16n(t):
    m = EV.body_match("place_name", "address", "title", "body")
    return t("notes_v").select("note_id", m["match_score"].alias("match_score"), m["accepted"].alias("accepted"), EV.title_rank("place_name", "category", "title").alias("title_score"))


@query("h17_extraction", uses="notes_v", sql=r"""
    SELECT note_id, trim(regexp_extract(body, '(?:地址|地点|位置)\s*[：:]\s*([^\n；;。]{5,80})', 1)) AS address, trim(regexp_extract(body, '(?:开放时间|营业时间)\s*[：:]\s*([^\n。]{4,120})', 1)) AS hours,
      regexp_matches(body, '开放时间|营业时间|服务时间|供餐时间|周[一二三四五六日天]|每天|每日|上午|下午|早餐|午餐|晚餐') AND regexp_matches(body, '(?:[01]?[0-9]|2[0-4])\s*[:：]\s*[0-5][0-9]')
        AND regexp_matches(body, '(?:开放时间|营业时间|服务时间|供餐时间)[^。；;\n]{0,80}(?:[01]?[0-9]|2[0-4])\s*[:：]\s*[0-5][0-9]') AS has_hours FROM notes_v""")
def h17(t):
    has_hours = F.coalesce(EV.holds_hours(F.col("body"), F.lit(False)), F.lit(False))
    return t("notes_v").select("note_id", T.labelled_address("body").alias("address"), T.labelled_hours("body").alias("hours"), has_hours.alias("has_hours"))


def _clauses(x):
    parts = ["CASE " + " ".join(f"WHEN {D.like(x, p)} THEN '{c}'" for p, c in opts) + " END" for opts in dims.FACILITY_CLAUSES]
    return f"list_filter([{', '.join(parts)}], lambda v: v IS NOT NULL)"


@query("h18_facility_clauses", uses="notes_v", sql=f"""
    SELECT note_id, CASE WHEN len(c) > 0 THEN array_to_string(c, '，') || '。' ELSE '' END AS clauses FROM (SELECT note_id, {_clauses('body')} AS c FROM notes_v)""")
def h18(t):
    return t("notes_v").select("note_id", T.facility_clauses("body").alias("clauses"))


@query("h19_condense", uses="places_v")
def h19(t):
    return t("places_v").select("id", T.condense("description", "name").alias("description"), T.merge_clauses("description", "hours").alias("merged"))


@query("h20_templates", uses="places_v", sql=r"""
    SELECT id, regexp_replace(trim(regexp_replace(description, '\s+', ' ', 'g')), '[。！？；;，,.!?]+$', '') AS description,
      CASE WHEN regexp_matches(name, '少年儿童|少儿') THEN '面向少年儿童开放，提供少儿图书阅览和阅读空间。' WHEN regexp_matches(name, '党群|党建') THEN '设在党群服务中心内，面向公众提供图书阅览、学习和自习空间。'
        WHEN regexp_matches(name, '街道|镇|乡|社区|分馆') THEN '面向社区开放，提供图书阅览、学习和自习空间。' ELSE '公共图书馆，提供图书阅览、学习和自习空间。' END AS library,
      '位于' || replace(regexp_replace(address, '\s', '', 'g'), '中国', '') || '，属于' || CASE WHEN regexp_matches(name, '湿地|湖|滨水|滨江|滨河|湖滨|河畔|岛|洲|滩|堤') THEN '滨水或湿地自然空间。游览范围围绕水岸、湿地或连续户外空间展开'
        WHEN regexp_matches(name, '山|岭|峰|谷|森林|风景区|景区') THEN '山林或自然游览空间。游览对象以山林地貌、植被或自然景观为主' WHEN regexp_matches(name, '植物园') THEN '植物展示与户外游览空间。游览对象以植物展示和户外绿地为主'
        ELSE '面向公众的户外自然空间。作为独立公园或绿地提供户外游览区域' END || '，可按该地址导航至公开标注位置' AS nature FROM places_v""")
def h20(t):
    return t("places_v").select("id", T.sanitize_description("description").alias("description"), T.library_description("name").alias("library"), T.nature_description("name", "address").alias("nature"))


@query("h21_aliases", uses="places_v", sql=f"""
    SELECT id, array_to_string(list_sort(list_distinct(list_filter([{D.alnum('name')}, {D.alnum("regexp_replace(name, '[（(].*?[）)]', '', 'g')")}], lambda v: length(v) >= 4))), ',') AS aliases,
      CASE WHEN regexp_matches(name, '[（(]([^）)]+)[）)]') THEN regexp_extract(name, '[（(]([^）)]+)[）)]', 1) ELSE name END AS branch,
      array_to_string(list_filter(regexp_extract_all(address, '([\\x{{4e00}}-\\x{{9fff}}]{{2,12}}(?:路|街|巷|弄|社区|花园|中心|书院|饭店))', 1), lambda v: v NOT IN ('上海市', '服务中心', '社区服务中心', '市民活动中心')), ',') AS terms
    FROM places_v""")
def h21(t):
    return t("places_v").select(
        "id", F.array_join(F.array_sort(T.name_aliases("name")), ",").alias("aliases"), T.branch_name("name").alias("branch"), F.array_join(T.address_terms("address", "上海"), ",").alias("terms"))


_INT, _PPL, _EXT = "greatest(library, desk_table, bookshelf)", "people", "outdoor"
_EXTERIOR = f"({_EXT} >= 0.35 AND {_INT} < 0.32 AND outdoor >= 0.3)"
_MARK = "(tconf >= 0.25 AND (txt = '小红书号' OR (txt = '2024.05.06' AND (tx < 0.16 OR tx + 0.2 > 0.84 OR ty < 0.16 OR ty + 0.04 > 0.84))))"
_EDGE = f"(tconf >= 0.25 AND NOT {_MARK} AND (tx < 0.16 OR tx + 0.2 > 0.84 OR ty < 0.16 OR ty + 0.04 > 0.84))"


@query("h22_vision_scores", uses="vision_v places_v", sql=f"""
    WITH v AS (SELECT v.*, p.category FROM vision_v v JOIN places_v p ON p.id = v.place_id)
    SELECT photo_id, round({_INT} * 7 + people * 4 + greatest(bookshelf, desk_table) * 3 + least(2.0, 0.5 * face_count + 0.7 * human_count)
        + CASE WHEN category = '图书馆' THEN bookshelf * 4 + library * 3 + desk_table * 2 - CASE WHEN food > 0.65 AND {_INT} < 0.25 AND greatest(bookshelf, library) < 0.25 THEN 20 ELSE 0 END ELSE food * 2 + desk_table * 2 END
        - CASE WHEN {_EXTERIOR} THEN 1.5 ELSE 0 END - CASE WHEN document > 0.6 AND {_INT} < 0.25 AND people < 0.25 THEN 7 ELSE 0 END - CASE WHEN {_MARK} THEN 12 ELSE 0 END - CASE WHEN {_EDGE} THEN 0.8 ELSE 0 END, 3) AS score,
      {_EXTERIOR} AS exterior, face_area >= 0.012 OR human_area >= 0.4 AS close_person,
      CASE WHEN {_EXTERIOR} THEN 'exterior' WHEN people >= greatest(desk_table, bookshelf, library, food) THEN 'people' WHEN desk_table >= greatest(bookshelf, library, food) THEN 'seating'
           WHEN greatest(bookshelf, library) >= food THEN 'shelves' ELSE 'food' END AS focus FROM v""")
def h22(t):
    return vision_features(t).select("photo_id", F.round("score", 3).alias("score"), "exterior", "close_person", "focus")


@query("h23_completeness", uses="places_v photos_v", sql="""
    SELECT p.id, CASE WHEN latitude <> 0 AND longitude <> 0 THEN 25 ELSE 0 END + least(length(address), 20) + CASE WHEN hours <> '' AND hours <> '以现场公示为准' THEN 10 ELSE 0 END + CASE WHEN description <> '' THEN 8 ELSE 0 END + least(coalesce(n, 0) * 3, 12) AS merge_score,
      least(length(address), 35) + CASE WHEN hours <> '' THEN 12 ELSE 0 END + CASE WHEN description <> '' THEN 12 ELSE 0 END + least(coalesce(n, 0) * 5, 20) AS audit_score
    FROM places_v p LEFT JOIN (SELECT place_id, count(*) AS n FROM photos_v GROUP BY 1) f ON f.place_id = p.id""")
def h23(t):
    p = DUP.with_photo_count(t("places_v"), t("photos_v"))
    return p.select("id", DUP.completeness().alias("merge_score"), DUP.completeness("audit").alias("audit_score"))


@query("h24_channels", uses="links_v", sql=r"""
    WITH l AS (SELECT place_id, lo, position, lp, title, raw_url, regexp_extract(raw_url, '//([^/]*)', 1) AS h FROM links_v)
    SELECT place_id, lo, position, lp, CASE WHEN contains(raw_url, 'xiaohongshu') THEN '小红书' WHEN contains(raw_url, 'dianping') THEN '大众点评' WHEN contains(raw_url, 'map.baidu') THEN '百度地图'
      WHEN ends_with(h, 'gov.cn') OR contains(h, 'library') THEN '官方' WHEN contains(h, 'baidu.com') THEN '百度' ELSE regexp_replace(h, '^www\.', '') END AS channel FROM l""")
def h24(t):
    return t("links_v").select("place_id", "lo", "position", "lp", K.infer_channel("raw_url", "title", F.lit("")).alias("channel"))


@query("h25_lists", uses="places_v", sql="""
    SELECT id, array_to_string(list_filter(list_transform(regexp_split_to_array(name || '； ' || address || ',,' || hours, '[;；,，\\n]'), lambda x: trim(x)), lambda x: x <> ''), '|') AS items FROM places_v""")
def h25(t):
    return t("places_v").select("id", F.array_join(T.parse_list(F.concat("name", F.lit("； "), "address", F.lit(",,"), "hours")), "|").alias("items"))


@query("h26_dates", uses="visits_v notes_v", sql="""
    SELECT note_id AS id, strftime(make_timestamp(CAST(published AS BIGINT) * 1000000), '%Y-%m-%d') AS day, strftime(make_timestamp(CAST(published + 28800 AS BIGINT) * 1000000), '%Y-%m-%d') AS local_day, published >= 1640966400 AS recent FROM notes_v""")
def h26(t):
    """UTC date, Shanghai date and cutoff test; half of the stored times are milliseconds."""
    raw = F.when(F.col("published") % 2 == 0, F.col("published")).otherwise(F.col("published") * 1000 + 999)
    ts = F.timestamp_seconds(files.epoch_seconds(raw))
    return t("notes_v").select(
        F.col("note_id").alias("id"), F.date_format(ts, "yyyy-MM-dd").alias("day"),
        F.date_format(F.from_utc_timestamp(ts, "Asia/Shanghai"), "yyyy-MM-dd").alias("local_day"), (ts >= F.to_timestamp(F.lit(dims.NOTE_CUTOFF))).alias("recent"))


@query("h27_page_links", sql=r"""
    SELECT page_id, unnest(range(1, len(h) + 1)) AS position, unnest(h) AS href FROM (SELECT page_id, regexp_extract_all(html, '(?is)<a\b[^>]*?\bhref\s*=\s*["'']([^"'']*)["''][^>]*>(.*?)</a>', 1) AS h FROM pages)""")
def h27a(t):
    return EV.html_links(t("pages")).select("page_id", "position", "href")


def _visible(x):
    """Visible text in SQL: scripts, styles, comments and tags out, entities resolved, white space squeezed."""
    steps = [(r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>", " "), (r"(?s)<!--.*?-->", " "), (r"(?s)<[^>]*>", " "), ("&nbsp;|&#160;", " "),
             ("&lt;", "<"), ("&gt;", ">"), ("&quot;|&#34;", '"'), ("&#39;|&apos;", "''"), ("&amp;", "&"), (D.SP + "+", " ")]
    for a, b in steps:
        x = f"regexp_replace({x}, '{a}', '{b}', 'g')"
    return f"trim({x})"


@query("h27_page_headings", sql=f"""
    SELECT page_id, block, CAST(part[3:3] AS INT) AS level, {_visible("regexp_extract(part, '(?is)^<h[1-6][^>]*>(.*?)</h[1-6]>', 1)")} AS heading,
      {_visible("regexp_replace(part, '(?is)^<h[1-6][^>]*>.*?</h[1-6]>', '')")} AS snippet
    FROM (SELECT page_id, unnest(p) AS part, unnest(range(0, len(p))) AS block FROM (
      SELECT page_id, string_split(regexp_replace(html, '(?i)(<h[1-6]\\b)', chr(1) || '\\1', 'g'), chr(1)) AS p FROM pages))
    WHERE regexp_matches(part, '(?i)^<h[1-6]\\b')""")
def h27b(t):
    return EV.html_headings(t("pages"))


@query("h27_page_tables", sql="""
    SELECT p_partkey AS page_id, i AS row_no, p_type AS section, i || '|' || p_name || ' & ' || i AS cells FROM part, (SELECT unnest(range(1, 51)) AS i) r WHERE i <= 1 + p_size % 4""")
def h27c(t):
    """One page per part: a table whose first, one-cell row names the section of the rows below."""
    row = lambda i: F.concat(F.lit("<tr><td>"), i.cast("string"), F.lit("</td>\n<td><b>"), F.col("p_name"), F.lit("</b> &amp; "), i.cast("string"), F.lit("</td></tr>"))
    rows = F.array_join(F.transform(F.sequence(F.lit(1), F.col("p_size") % 4 + 1), row), "")
    html = F.concat(F.lit("<html><table class='x'><TR><th colspan=2>"), F.col("p_type"), F.lit("</th></TR>"), rows, F.lit("</table></html>"))
    return EV.html_table_rows(t("part").select(F.col("p_partkey").alias("page_id"), html.alias("html")))


@query("h27_page_text", sql=f"SELECT page_id, {_visible('html')} AS visible FROM pages")
def h27d(t):
    return t("pages").select("page_id", EV.html_text("html").alias("visible"))


_TEMPL = [("baidu", "https://www.baidu.com/s?wd=", "r"), ("sogou", "https://www.sogou.com/web?query=", "r"), ("amap", "https://www.amap.com/search?query=", "n"), ("weibo", "https://s.weibo.com/weibo?q=", "n")]


@query("h28_query_plan", uses="places_v", sql=r"""
    SELECT p.id, c.channel, CASE WHEN c.channel IN ('baidu', 'sogou') THEN '"' || n || '" 地址 开放时间 ' || category ELSE n END AS query, c.base || replace(url_encode(CASE WHEN c.channel IN ('baidu', 'sogou') THEN '"' || n || '" 地址 开放时间 ' || category ELSE n END), '%20', '+') AS url
    FROM (SELECT id, category, trim(regexp_replace(regexp_replace(name, '[（）()]', ' ', 'g'), '\s+', ' ', 'g')) AS n FROM places_v) p,
      (SELECT unnest(['baidu', 'sogou', 'amap', 'weibo']) AS channel, unnest(['https://www.baidu.com/s?wd=', 'https://www.sogou.com/web?query=', 'https://www.amap.com/search?query=', 'https://s.weibo.com/weibo?q=']) AS base) c""")
def h28(t):
    return EV.query_plan(t("places_v"), [
        ("baidu", "https://www.baidu.com/s?wd=", '"{name}" 地址 开放时间 {category}'), ("sogou", "https://www.sogou.com/web?query=", '"{name}" 地址 开放时间 {category}'),
        ("amap", "https://www.amap.com/search?query=", "{name}"), ("weibo", "https://s.weibo.com/weibo?q=", "{name}")])
