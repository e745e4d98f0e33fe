"""Literal cases for the column functions."""

import pytest
from pyspark.sql import functions as F

from placeloom.functions import geo, keys as K, rules, text as T
from placeloom.operators import evidence as EV, matching as M, select, visits as V


def one(spark, expr, **cols):
    df = spark.createDataFrame([tuple(cols.values())], list(cols)) if cols else spark.range(1)
    return df.select(expr.alias("x")).first()["x"]


SCORES = [
    ("浦东图书馆", "上海市浦东新区前程路88号", "上海浦东图书馆(总馆)", "上海市浦东新区前程路88号", True),
    ("浦东图书馆", "上海市浦东新区前程路88号", "浦东图书馆", "上海市浦东新区合欢路300号", False),
    ("某社区食堂", "上海市浦东新区下盐路3824号", "某社区食堂", "上海市浦东新区下盐公路3824号", True),
    ("某社区食堂", "上海市静安区新闸路1708号", "某社区食堂", "上海市静安区新闸路1702-1708号", True),
    ("某图书馆", "苏州高新区太湖大道999号", "某图书馆", "苏州市虎丘区太湖大道999号", True),
    ("某社区食堂", "上海市徐汇区岳阳路77弄20号", "某社区食堂", "上海市徐汇区岳阳路200弄20号", False),
    ("某图书馆", "嘉兴市南湖区海盐塘路339号", "某图书馆", "浙江省嘉兴市南湖区海盐塘路339号", True),
    ("某图书馆", "无锡市梁溪区钟书路1号", "某图书馆", "江苏省无锡市梁溪区钟书路1号", True),
]


@pytest.mark.parametrize("name,address,cname,caddress,accepted", SCORES)
def test_candidate_score(spark, name, address, cname, caddress, accepted):
    row = spark.createDataFrame([(name, address, cname, caddress)], "name string, address string, cand_name string, cand_address string")
    assert row.select(M.score_columns()["accepted"].alias("x")).first()["x"] is accepted


AUDITS = [
    ("自习图书室", "图书馆", ["excluded_place_type"]), ("某某书房", "图书馆", ["excluded_place_type"]), ("党群服务中心", "图书馆", ["excluded_place_type"]),
    ("城市书房图书馆", "图书馆", []), ("党群服务中心图书馆", "图书馆", []), ("复旦大学图书馆", "图书馆", ["school_library"]),
    ("黄浦区机关图书馆", "图书馆", ["restricted_institution"]), ("长海路街道图书馆（政府路馆）", "图书馆", []),
    ("某集团职工食堂", "食堂", ["restricted_institution", "ineligible_canteen"]), ("金汇社区食堂", "食堂", []), ("自选大食堂", "食堂", ["ineligible_canteen"]),
    ("滨河公园", "自然", []), ("某小区内部绿地", "自然", ["ineligible_nature_place"]), ("某自习室", "自习室", ["unsupported_category"]),
]


@pytest.mark.parametrize("name,category,expected", AUDITS)
def test_audit_codes(spark, name, category, expected):
    df = spark.createDataFrame([(name, category, "上海市黄浦区人民路1号", 31.2, 121.4)], "name string, category string, address string, latitude double, longitude double")
    assert df.select(rules.record_issues().alias("x")).first()["x"] == expected


def test_rural_address_has_a_locator(spark):
    df = spark.createDataFrame([("金汇社区食堂", "食堂", "上海市奉贤区金汇镇金汇村金星104号", 31.0, 121.4)], "name string, category string, address string, latitude double, longitude double")
    assert df.select(rules.record_issues().alias("x")).first()["x"] == []


def test_record_audit_points(spark):
    ddl = "name string, category string, address string, latitude double, longitude double"
    df = spark.createDataFrame([("", "图书馆", "", float("nan"), 121.0), ("某图书馆", "图书馆", "某路", 10.0, 100.0)], ddl)
    a, b = [r["x"] for r in df.select(rules.record_issues().alias("x")).collect()]
    assert a == ["missing_name", "missing_address", "missing_district", "missing_street_number", "invalid_coordinates"]
    assert b == ["missing_district", "missing_street_number", "outside_supported_city_bounds"]


@pytest.mark.parametrize("km,text", [(None, ""), (float("nan"), ""), (-1.0, ""), (0.32, "320 米"), (1.26, "1.3 公里"), (1.15, "1.1 公里"), (1.25, "1.3 公里"), (2.0, "2.0 公里")])
def test_distance_text(spark, km, text):
    df = spark.createDataFrame([(km,)], "km double")
    assert df.select(geo.distance_text(F.col("km")).alias("x")).first()["x"] == text


def test_clean_text_drops_every_space(spark):
    assert one(spark, T.clean_text("v"), v="a&nbsp;b　c d﻿e\tf g") == "abcdefg"


def test_normalisers(spark):
    assert one(spark, T.normalize_name("v"), v="上海浦东图书馆(总馆)") == "浦东图书"
    assert one(spark, T.normalize_name("v", "dedupe"), v="上海市 A·B（x）-馆") == "ab馆"
    assert one(spark, T.normalize_address("v"), v="上海市浦东新区 前程路88号（二楼）") == "浦东新区前程路88号"
    assert one(spark, T.extract_district("v"), v="江苏省苏州市虎丘区路") == "虎丘区"
    assert one(spark, T.street_number("v"), v="浦东新区甲路1号乙路22号") == "乙路22号"
    assert one(spark, T.street_number("v"), v="无门牌") == ""


def test_road_numbers(spark):
    r = one(spark, T.road_numbers("v"), v="上海市静安区新闸路1702-1708号")
    assert [(x["road"], x["numbers"], x["lane"]) for x in r] == [("新闸路", ["1702", "1708"], None)]
    assert one(spark, T.road_number("v"), v="上海市徐汇区岳阳路77弄20号") == "岳阳路77弄20"
    assert one(spark, T.road_number("v"), v="上海市徐汇区") == ""


def test_repair_address(spark):
    assert one(spark, T.repair_address("v"), v="中国上海市浦东新区浦东新区人民路1号公园内") == "上海市浦东新区人民路1号"
    assert one(spark, T.repair_address("v"), v="江苏省苏州市姑苏区平江街道平江街道平江路1号(地铁站旁)，") == "苏州市姑苏区平江街道平江路1号"
    assert one(spark, T.address_issues("v"), v="上海市浦东新区花木街道路花木街道") == ["repeated_street"]


def test_url_keys(spark):
    a, b = "HTTPS://A.example.com/x/?b=2&a=1&a=0#f", "https://a.example.com/x?a=0&a=1&b=2"
    assert one(spark, K.request_key("a") == K.request_key("b"), a=a, b=b)
    assert one(spark, K.canonical_url("a"), a=a) == "https://a.example.com/x?a=0&a=1&b=2"
    assert one(spark, K.source_url("a"), a="http://x.cn/p?utm_source=q&id=1&SRC=2") == "http://x.cn/p?id=1"
    assert one(spark, K.source_url("a"), a="javascript:void(0)") == ""
    assert one(spark, K.domain_in("a"), a="https://map.baidu.com/") and not one(spark, K.domain_in("a"), a="https://notbaidu.com/")


def test_identity(spark):
    vid = one(spark, K.visitor_id("o", "a"), o="openid-123", a="appid-456")
    assert vid == one(spark, K.visitor_id("o", "a"), o="openid-123", a="appid-456") and len(vid) == 64
    import re

    assert re.fullmatch("[A-F0-9]{6}", one(spark, K.visitor_code(K.visitor_id("o", "a")), o="openid-123", a="appid-456"))


GEO = """{"status":0,"result":{"ad_info":{"nation":"中国","province":"%s","city":"%s","district":"黄浦区"},"address_component":{"street":"人民路","street_number":"人民路1号"},
"formatted_addresses":{"standard_address":"标准地址","recommend":"推荐"},"pois":%s}}"""


def test_reverse_geocode(spark):
    sh = GEO % ("上海市", "上海市", '[{"title":"某站","category":"交通","_distance":70},{"title":"某花园","category":"住宅","_distance":150}]')
    bj = GEO % ("北京市", "", "[]")
    df = spark.createDataFrame([(sh, 31.2, 121.4), (bj, 39.9, 116.4), (None, 31.2, 121.4), ('{"status":1}', 39.0, 116.0)], "payload string, latitude double, longitude double")
    rows = V.flatten_geocode(df).select("city", "street", "place_name", "address", "location_level", "is_shanghai").collect()
    assert tuple(rows[0]) == ("上海市", "人民路1号", "某花园", "标准地址", "place", True)
    assert tuple(rows[1]) == ("北京市", "人民路1号", "", "标准地址", "street", False)
    assert tuple(rows[2]) == ("上海市", "", "", "", "unknown", True)
    assert tuple(rows[3]) == ("", "", "", "", "unknown", False)


def test_viewport_rules(spark):
    rows = [("inside", "图书馆", 31.5, 121.5), ("edge", "图书馆", 31.0, 121.0), ("wrong", "食堂", 31.5, 121.5), ("south", "图书馆", 30.9, 121.5), ("east", "图书馆", 31.5, 122.1)]
    df = spark.createDataFrame(rows, "id string, category string, latitude double, longitude double")
    out, more = select.viewport(df, select.ordered_box(32, 122, 31, 121), "图书馆")
    assert [r.id for r in out.collect()] == ["edge", "inside"] and not more
    assert select.ordered_box(None, 1, 2, 3) is None and select.viewport(df, None)[0].count() == 0
    assert (select.clamp_limit(None), select.clamp_limit(9999), select.clamp_limit("x"), select.clamp_limit(-4)) == (200, 500, 200, 1)
    many = spark.range(501).select(F.lpad(F.col("id").cast("string"), 4, "0").alias("id"), F.lit("食堂").alias("category"), F.lit(31.5).alias("latitude"), F.lit(121.5).alias("longitude"))
    box = (31.0, 32.0, 121.0, 122.0)
    top, more = select.viewport(many, box, limit=500)
    assert top.count() == 500 and more
    assert not select.viewport(many.where("id < '0500'"), box, limit=500)[1]


def test_paging(spark):
    df = spark.createDataFrame([("c",), ("a",), ("b",)], "id string")
    p1 = select.stable_page(df, 0, 2).collect()
    assert [(r.id, r.has_more, r.next_offset) for r in p1] == [("a", True, 2), ("b", True, 2)]
    assert [(r.id, r.has_more) for r in select.stable_page(df, 2, 2).collect()] == [("c", False)]
    assert [r.id for r in select.page_after(df, "a", 5).collect()] == ["b", "c"]


def test_condense(spark):
    text = "某公园位于人民路；园内设有健身步道和大草坪，景色宜人。设有健身步道，配有儿童游乐场地。此处环境优美，流连忘返"
    out = one(spark, T.condense("d", "n"), d=text, n="某公园")
    assert out == "设有健身步道和大草坪；配有儿童游乐场地"
    assert one(spark, T.condense("d", "n"), d="x，可按该地址导航至公开标注位置", n="x") == ""
    long = "设有步道" + "、".join(["草坪花园"] * 14)
    cut = one(spark, T.condense("d", "n"), d=long, n="x")
    assert len(cut) <= 64 and long.startswith(cut)


def test_clauses(spark):
    assert one(spark, T.facility_clauses("d"), d="没有热水，厕所很干净，插座少，wifi 可用") == "不提供热水，厕所整洁，电源插座数量有限，提供 Wi-Fi。"
    assert one(spark, T.facility_clauses("d"), d="") == ""
    assert one(spark, T.merge_clauses("a", "b"), a="有步道，有厕所。", b="有厕所；有座椅") == "有步道，有厕所，有座椅。"
    assert one(spark, T.shortest_name("d", "图书馆"), d="今天去了上海的某街道图书馆\n打卡：某馆图书馆") == "某馆图书馆"


def test_page_structure(spark):
    html = """<h2>One &amp; two</h2><p>first <b>x</b></p><h3>Two</h3>text<table><tr><th>Part A</th></tr><tr><td>1</td><td>a</td></tr><tr><td>2</td><td>b</td></tr>
    <tr><td>Part B</td></tr><tr><td>3</td><td>c</td></tr></table><script>var t="</p>";</script><a class="k" href='/x?a=1&amp;b=2'>go <i>there</i></a>"""
    df = spark.createDataFrame([(1, html)], "page_id int, html string")
    heads = [(r.level, r.heading) for r in EV.html_headings(df).orderBy("block").collect()]
    assert heads == [(2, "One & two"), (3, "Two")]
    rows = [(r.section, r.cells) for r in EV.html_table_rows(df).orderBy("row_no").collect()]
    assert rows == [("Part A", "1|a"), ("Part A", "2|b"), ("Part B", "3|c")]
    link = EV.html_links(df).first()
    assert (link.href, link.label) == ("/x?a=1&b=2", "go there")
    md = spark.createDataFrame([(1, "### [T **one**](https://a.cn/1)\nline a\nline b\n### [two](https://a.cn/2)\nz\n# other")], "page_id int, text string")
    res = [(r.position, r.title, r.url, r.snippet) for r in EV.markdown_results(md).orderBy("position").collect()]
    assert res == [(1, "T one", "https://a.cn/1", "line a line b"), (2, "two", "https://a.cn/2", "z other")]
