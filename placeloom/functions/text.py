"""Text normalisation, address parsing and prose extraction as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from placeloom import dims

# Java's \s leaves out the wide, no-break and zero-width-BOM spaces, so the class is spelled out.
SPACE = r"[\s\u0085   -     　﻿]"
BRACKETS = r"[（(【\[].*?[）)】\]]"
ROUND_BRACKETS = r"[（(].*?[）)]"
NOT_WORD = r"[^0-9a-z一-鿿]+"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def sub(c, *steps: tuple[str, str]) -> Column:
    """Apply (pattern, replacement) steps in order."""
    out = col(c)
    for pattern, replacement in steps:
        out = F.regexp_replace(out, pattern, replacement)
    return out


def text(c) -> Column:
    return F.coalesce(col(c), F.lit(""))


def strip(c) -> Column:
    return sub(text(c), (f"^{SPACE}+|{SPACE}+$", ""))


def ngrams(c, n: int) -> Column:
    """All n-letter pieces in order; one linear pass by look-ahead."""
    return F.regexp_extract_all(col(c), F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1))


def clean_text(c) -> Column:
    return sub(text(c), ("(?i)&nbsp;|&#160;", " "), (f"{SPACE}+", ""))


def squeeze(c) -> Column:
    """Runs of white space become one blank, ends trimmed."""
    return F.trim(sub(text(c), (f"{SPACE}+", " ")))


def alnum_key(c) -> Column:
    """Lower case, only ASCII letters, digits and Han characters."""
    return sub(F.lower(text(c)), (NOT_WORD, ""))


# Ordered replacement chains per matching task.
NAME_PROFILES = {
    "quality": [
        (BRACKETS, ""),
        ("上海市?|苏州市?|嘉兴市?|南通市?|无锡市?|镇江市?|社区|街道|乡|镇|文化活动中心|文化中心|服务中心|分馆|馆", ""),
        (r"""[·•,，.。:：;；/\\_\-—&“”"'’]""", ""),
    ],
    "notes": [
        (r"[（）()【】\[\]]", ""),
        ("上海市?|区|县|社区|街道|乡|镇|党群服务中心|文化活动中心|文化中心|服务中心|图书馆|分馆|馆|长者|老年|食堂|助餐点", ""),
        (r"""[·•,，.。:：;；/\\_\-—&“”"'’]""", ""),
    ],
    "compact": [(r"""[（）()【】\[\]·•,，.。:：;；/\\_\-—&“”"'’]""", "")],
    "new_city": [
        ("嘉兴市?|南通市?|无锡市?|镇江市?|社区|街道|乡|镇|分馆|馆", ""),
        (r"[^0-9a-z一-鿿]", ""),
    ],
    "suzhou": [
        ("上海市?|苏州市?|社区|街道|乡|镇|文化活动中心|文化中心|服务中心|分馆|馆", ""),
        (NOT_WORD, ""),
    ],
}


def normalize_name(c, profile: str = "quality") -> Column:
    if profile == "dedupe":
        return dedupe_key(c)
    if profile == "nature_map":
        return sub(clean_text(c), (r"(?:苏州|南通|无锡|嘉兴|镇江)市?|国家级?|省级?|[（）()·•_\-—]", ""))
    if profile == "nature":
        return sub(clean_text(c), (r"[（）()\-_·•]", ""), ("一期|二期", ""))
    return sub(F.lower(clean_text(c)), *NAME_PROFILES[profile])


def dedupe_key(c) -> Column:
    return sub(F.lower(text(c)), ("上海市?", ""), (BRACKETS, ""), (rf"(?:{SPACE}|[·•,，.。:：;；/\\_\-—&])+", ""))


def normalize_address(c, profile: str = "quality") -> Column:
    if profile == "dedupe":
        return sub(dedupe_key(c), ("中国|上海市", ""), ("号楼", "号"))
    if profile == "notes":
        return sub(clean_text(c), ("^上海市?", ""), (r"[（）()，,。.、:：;；/\\_\-—]", ""), (r"[一二三四五六七八九十\d]+楼.*$", ""))
    return sub(clean_text(c), (dims.CITY_PREFIX, ""), (ROUND_BRACKETS, ""), (r"[，,。.、:：;；/\\_\-—]", ""))


def extract_district(c) -> Column:
    return F.regexp_extract(clean_text(c), "|".join(dims.DISTRICTS), 0)


def canonical_district(c) -> Column:
    d = extract_district(c)
    out = d
    for name, target in dims.DISTRICT_ALIASES.items():
        out = F.when(d == name, F.lit(target)).otherwise(out)
    return out


def road_text(c) -> Column:
    return sub(clean_text(c), (dims.CITY_PREFIX, ""), (r"[，,。.、:：;；\\_—]", ""), ("临时服务点[:：]?", ""))


def _road_name(c: Column) -> Column:
    return sub(c, ("^.*?(?:区|县)", ""), ("^.*?(?:街道|镇|乡)", ""), ("公路$|大道$", "路"))


def road_numbers(c) -> Column:
    """array<struct<road, numbers, lane>>; lane is NULL when the address names none."""
    return roads_in(road_text(c))


def roads_in(base) -> Column:
    """road_numbers of a text that road_text has made; a caller that keeps it as a column has it made once."""
    parts = [F.regexp_extract_all(col(base), F.lit(dims.ROAD_NUMBER), F.lit(i)) for i in (1, 2, 3, 4)]
    zipped = F.arrays_zip(*[p.alias(n) for p, n in zip(parts, ("road", "n1", "n2", "lane"))])
    return F.transform(
        zipped,
        lambda m: F.struct(
            _road_name(m["road"]).alias("road"),
            F.filter(F.array(m["n1"], m["n2"]), lambda v: v != "").alias("numbers"),
            F.nullif(m["lane"], F.lit("")).alias("lane"),
        ),
    )


def road_number(c) -> Column:
    """First road + house number (+ lane), '' when there is none."""
    return first_road(road_text(c))


def first_road(base) -> Column:
    first = F.try_element_at(roads_in(base), F.lit(1))
    lane = F.when(first["lane"].isNull(), F.lit("")).otherwise(F.concat(F.lit("弄"), first["lane"]))
    return F.coalesce(F.concat(first["road"], first["numbers"][0], lane), F.lit(""))


def street_number(c) -> Column:
    """Last street + number, '' when there is none."""
    base = sub(text(c), (f"{SPACE}+", ""))
    hits = F.regexp_extract_all(base, F.lit(dims.STREET_NUMBER), F.lit(0))
    return F.coalesce(F.try_element_at(hits, F.lit(-1)), F.lit(""))


def note_road_number(c) -> Column:
    pattern = r"([^区县\d]{1,30}(?:公路|大道|路|街|道|弄|巷|村))(\d+)(?:弄(\d+))?号?"
    base = normalize_address(c, "notes")
    return F.concat(*[F.regexp_extract(base, pattern, i) for i in (1, 2, 3)])


def roads_match(a: Column, b: Column) -> Column:
    """Any road/number pair in common between two road_numbers arrays."""
    def same(x, y):
        road = (x["road"] == y["road"]) | x["road"].endswith(y["road"]) | y["road"].endswith(x["road"])
        lane = x["lane"].isNull() | y["lane"].isNull() | (x["lane"] == y["lane"])
        return road & F.arrays_overlap(x["numbers"], y["numbers"]) & lane

    return F.exists(a, lambda x: F.exists(b, lambda y: same(x, y)))


def similarity(a: Column, b: Column) -> Column:
    """1 - edit distance / longer length; 0 when either side is empty."""
    longest = F.greatest(F.length(a), F.length(b))
    return F.when((a == "") | (b == ""), F.lit(0.0)).otherwise(1 - F.levenshtein(a, b) / longest)


def contains_either(a: Column, b: Column) -> Column:
    return a.contains(b) | b.contains(a)


def names_related(a: Column, b: Column) -> Column:
    return (a != "") & (b != "") & contains_either(a, b)


def repair_address(c) -> Column:
    """Drop repeated divisions, side remarks and trailing place names of a map address."""
    out = sub(strip(c), ("^中国", ""), ("^(?:江苏省|浙江省)(?=(?:苏州市|无锡市|南通市|镇江市|嘉兴市))", ""),
              (f"{SPACE}+", ""), ("(?<!^)上海市", ""), ("(?<!^)苏州市", ""))
    for _ in range(8):
        out = sub(out, (r"([一-鿿]{2,8}街道)(?:\1)+", "$1"), (r"([一-鿿]{1,8}区)(?:\1)+", "$1"),
                  (r"([一-鿿]{1,8}镇)(?:\1)+", "$1"), (r"([一-鿿]{1,8}乡)(?:\1)+", "$1"))
    out = sub(out, (r"\((?:[^)]*(?:地铁站|步行|建设中|装修中)[^)]*)\)", ""), (r"[，,。；;]+$", ""))
    # what follows the last 号 is cut when it names a place or a side of it
    tail = "公园|景区|绿地|休闲苑|图书馆|酒店|大厦|学校|地铁站|内|楼|栋|室|[东西南北]侧|方向|靠近"
    return sub(out, (rf"^(.*号)(?=[^号]*$)(?=[^号]*(?:{tail}))[^号]*$", "$1"))


def address_issues(c) -> Column:
    a, at = col(c), col(c)
    checks = [
        ("missing_city", ~a.rlike(dims.CITY_START)),
        ("missing_district", extract_district(at) == ""),
        ("missing_location_detail", ~a.rlike(dims.ADDRESS_PLACE)),
        ("description_text", a.rlike(dims.ADDRESS_PROSE)),
        ("too_long", F.length(a) > 80),
        ("repeated_street", a.rlike(r"([一-鿿]{2,8}街道)(?:.*\1)")),
        ("repeated_division_suffix", a.rlike("区区|市市|县县")),
    ]
    return codes(checks)


def codes(checks) -> Column:
    """array of the names whose condition holds, in the given order."""
    return F.array_compact(F.array(*[F.when(cond, F.lit(name)) for name, cond in checks]))


def address_score(c) -> Column:
    a = col(c)

    def points(pattern, n):
        return F.when(a.rlike(pattern), n).otherwise(0)

    return (
        points(dims.CITY_START, 2) + F.when(extract_district(a) != "", 2).otherwise(0) + points(dims.ADDRESS_PLACE, 2)
        + points(r"\d+(?:[—–-]\d+)?号", 8) + points("交叉口|交汇处|路口|交界处", 5)
        + points(r"[东西南北](?:侧|角|约|\d)", 2) - F.size(address_issues(a)) * 8
    )


def nature_address(city: Column, district_hint, map_address, hint) -> Column:
    """Map address when it is specific, else city + district + the rest of the hint."""
    def tidy(x):
        steps = [("^中国", ""), ("^(?:上海|江苏|浙江)省", "")]
        steps += [(f"^(?:{c}市){{2,}}", f"{c}市") for c in dims.CITIES]
        return strip(sub(text(x), *steps))

    m, h = tidy(map_address), tidy(hint)
    district = extract_district(F.concat_ws(" ", m, text(district_hint), h))
    locator = "路|街|巷|弄|大道|公路|村|镇|乡|园|苑|湖|河|浜|港|桥|交叉口|口|旁|侧|段|沿线"
    rest_of_map = F.substr(m, F.length(city) + F.length(district) + 1)
    no_city = F.when(h.startswith(city), F.substr(h, F.length(city) + 1)).otherwise(h)
    no_district = F.when(
        (district != "") & no_city.startswith(district), F.substr(no_city, F.length(district) + 1)
    ).otherwise(no_city)
    return (
        F.when(m.startswith(city) & (district != "") & rest_of_map.rlike(locator), m)
        .when(h != "", F.concat(city, district, no_district))
        .when(m.startswith(city), m)
        .otherwise(F.concat(city, m))
    )


def parse_list(c) -> Column:
    return F.filter(F.transform(F.split(text(c), r"[;；,，\n]"), strip), lambda v: v != "")


def sanitize_description(c) -> Column:
    return sub(squeeze(c), (r"[。！？；;，,.!?]+$", ""))


def clean_markdown(c) -> Column:
    return squeeze(sub(
        text(c), (r"!\[[^\]]*\]\([^)]+\)", ""), (r"\[([^\]]+)\]\([^)]+\)", "$1"), (r"https?://\S+", ""), (r"[#_*|`]+", " "),
    ))


def sentences(c) -> Column:
    parts = F.split(text(c), r"(?<=[。！？!?；;])\s*|\s{2,}")
    return F.filter(F.transform(parts, strip), lambda v: v != "")


def name_aliases(c, min_len: int = 4) -> Column:
    name = text(c)
    forms = F.array(alnum_key(name), alnum_key(sub(name, (ROUND_BRACKETS, ""))), alnum_key(sub(name, ("[（）()]", ""))))
    return F.array_distinct(F.filter(forms, lambda v: F.length(v) >= min_len))


def branch_name(c) -> Column:
    name = text(c)
    inner = F.regexp_extract(name, "[（(]([^）)]+)[）)]", 1)
    outer = strip(sub(name, ("^苏州书房[·・]", ""), ("^苏州图书馆", ""), ("分馆.*$", "")))
    return F.when(inner != "", strip(sub(inner, ("分馆.*$", ""), ("苏州书房", "")))).otherwise(outer)


def nature_base_name(c) -> Column:
    return strip(sub(text(c), (ROUND_BRACKETS, ""), ("[一二三四五六七八九十]+期$", ""), ("^新区", "")))


def region_term(c, city: str) -> Column:
    hit = F.regexp_extract(text(c), "([^市]{2,8}(?:区|县)|[^省市]{2,8}市)(?=[^市]|$)", 1)
    return F.when(hit == "", F.lit(city)).otherwise(sub(hit, ("^.*市", "")))


def address_terms(c, city: str) -> Column:
    hits = F.regexp_extract_all(
        text(c), F.lit(r"([一-鿿]{2,12}(?:路|街|巷|弄|社区|花园|中心|书院|饭店))"), F.lit(1))
    generic = [f"{city}市", "服务中心", "社区服务中心", "市民活动中心"]
    kept = F.filter(hits, lambda v: ~v.isin(generic))
    return F.when(F.size(kept) > 3, F.slice(kept, -3, 3)).otherwise(kept)


def facility_clauses(c) -> Column:
    """One clause per facility, the negative wording tested first; joined and ended with a full stop."""
    source = text(c)
    picked = []
    for options in dims.FACILITY_CLAUSES:
        expr = None
        for pattern, clause in options:
            expr = F.when(source.rlike(pattern), F.lit(clause)) if expr is None else expr.when(
                source.rlike(pattern), F.lit(clause))
        picked.append(expr)
    clauses = F.array_distinct(F.array_compact(F.array(*picked)))
    return F.when(F.size(clauses) > 0, F.concat(F.array_join(clauses, "，"), F.lit("。"))).otherwise(F.lit(""))


def labelled_address(c) -> Column:
    return F.trim(F.regexp_extract(text(c), r"(?:地址|地点|位置)\s*[：:]\s*([^\n；;。]{5,80})", 1))


def labelled_hours(c) -> Column:
    return F.trim(F.regexp_extract(text(c), r"(?:开放时间|营业时间)\s*[：:]\s*([^\n。]{4,120})", 1))


def shortest_name(c, ending: str) -> Column:
    """Shortest phrase that ends with the given suffix pattern; first one on ties."""
    hits = F.regexp_extract_all(text(c), F.lit(rf"([^\n，。；;#]{{2,36}}(?:{ending}))"), F.lit(1))
    tidy = F.transform(hits, lambda v: strip(sub(
        v, ("^[《【「]|[》】」]$", ""), (r"^(?:探店|打卡|上海|寻找\d+家|推荐)[｜|：:\s-]*", ""), ("[｜|：:#].*$", ""))))
    sized = F.transform(F.filter(tidy, lambda v: F.length(v) <= 40), lambda v, i: F.struct(
        F.length(v).alias("n"), i.alias("i"), v.alias("v")))
    return F.coalesce(F.array_min(sized)["v"], F.lit(""))


def location_phrase(c) -> Column:
    return sub(F.regexp_extract(clean_text(c), r"(?:位于|坐落于|地处)([^。；;]{4,90})", 1), ("^[，, ]+|[，, ]+$", ""))


def merge_clauses(current, incoming) -> Column:
    def parts(c):
        return F.filter(F.transform(F.split(sub(text(c), ("[。.!！]+$", "")), "[，,；;]"), strip), lambda v: v != "")

    merged = F.array_distinct(F.concat(parts(current), parts(incoming)))
    return F.when(F.size(merged) > 0, F.concat(F.array_join(merged, "，"), F.lit("。"))).otherwise(F.lit(""))


def library_description(name) -> Column:
    n = text(name)
    return (
        F.when(n.rlike("少年儿童|少儿"), "面向少年儿童开放，提供少儿图书阅览和阅读空间。")
        .when(n.rlike("党群|党建"), "设在党群服务中心内，面向公众提供图书阅览、学习和自习空间。")
        .when(n.rlike("街道|镇|乡|社区|分馆"), "面向社区开放，提供图书阅览、学习和自习空间。")
        .otherwise("公共图书馆，提供图书阅览、学习和自习空间。")
    )


def condense(
    description, name, useful: str = dims.USEFUL_CLAUSE, filler: str = dims.FILLER_CLAUSE,
    clauses: int = 4, enough: int = 130, longest: int = 150, clause: int = 64,
) -> Column:
    """Keep up to `clauses` factual clauses, none contained in another, until `enough` characters are there.

    A summary of a fixed format: a clause longer than `clause` characters ends at its last enumeration mark, and
    the summary is `longest` characters long at most.
    A fold over the clauses of ONE text value, so its cost follows that text alone.
    """
    original = F.regexp_replace(sub(text(description), (f"{SPACE}+", "")), "[；;]", "。")
    quoted = F.concat(F.lit("^\\Q"), text(name), F.lit("\\E(?:简介)?"))

    def tidy(piece):
        piece = F.regexp_replace(piece, quoted, F.lit(""))
        return strip(sub(piece, ("^(?:本公园|该公园|公园|绿地|园区)", ""), ("^位于.{0,60}$", ""),
                         ("^(?:园内|公园内|全园)", ""), ("^(?:其中|主要|同时|并且|以及|通过|结合)", "")))

    pieces = F.filter(
        F.transform(F.split(original, "[。！？!?；;：:，,]"), tidy),
        lambda v: (F.length(v) >= 5) & (F.length(v) <= 90) & v.rlike(useful) & ~v.rlike(filler))
    # too long: cut after the last enumeration mark or bracket that still fits, if at 30 or later
    clipped = F.transform(pieces, lambda v: F.when(F.length(v) <= clause, v).otherwise(
        F.regexp_extract(F.substring(v, 1, clause), "^(.{30,}[、）)])", 1)))
    empty = F.array().cast("array<string>")

    def step(acc, v):
        full = (F.length(F.array_join(acc, "；")) >= enough) | (F.size(acc) >= clauses)
        known = F.exists(acc, lambda s: s.contains(v) | v.contains(s))
        return F.when(full | (v == "") | known, acc).otherwise(F.array_append(acc, v))

    joined = sub(F.array_join(F.aggregate(clipped, empty, step), "；"), ("[、，,。；;！!？?]+$", ""))
    return F.when(original.contains("可按该地址导航至公开标注位置"), F.lit("")).otherwise(F.substring(joined, 1, longest))


def nature_description(name, address) -> Column:
    n, a = clean_text(name), F.regexp_replace(clean_text(address), "中国", "")
    options = [
        ("湿地|湖|滨水|滨江|滨河|湖滨|河畔|岛|洲|滩|堤", "滨水或湿地自然空间", "游览范围围绕水岸、湿地或连续户外空间展开"),
        ("山|岭|峰|谷|森林|风景区|景区", "山林或自然游览空间", "游览对象以山林地貌、植被或自然景观为主"),
        ("植物园", "植物展示与户外游览空间", "游览对象以植物展示和户外绿地为主"),
    ]
    tail = "，可按该地址导航至公开标注位置"
    out = None
    for pattern, kind, detail in options:
        value = F.concat(F.lit("位于"), a, F.lit(f"，属于{kind}。{detail}{tail}"))
        out = F.when(n.rlike(pattern), value) if out is None else out.when(n.rlike(pattern), value)
    return out.otherwise(F.concat(
        F.lit("位于"), a, F.lit(f"，属于面向公众的户外自然空间。作为独立公园或绿地提供户外游览区域{tail}")))
