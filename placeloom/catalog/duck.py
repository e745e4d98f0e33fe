"""Text helpers for the check SQL (DuckDB dialect, RE2 patterns)."""

from __future__ import annotations

from placeloom import dims

SP = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
PUNCT = r"""[·•,，.。:：;；/\\_\-—&“”"'’]"""
BR = r"[（(【\[].*?[）)】\]]"
RB = r"[（(].*?[）)]"
CITY = "^(?:上海|苏州|嘉兴|南通|无锡|镇江)市?"
ROAD = dims.ROAD_NUMBER


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def rr(x: str, *steps: tuple[str, str]) -> str:
    for p, r in steps:
        x = f"regexp_replace({x}, {q(p)}, {q(r)}, 'g')"
    return x


def like(x: str, p: str) -> str:
    return f"regexp_matches({x}, {q(p)})"


def clean(x: str) -> str:
    return rr(f"coalesce({x}, '')", ("(?i)&nbsp;|&#160;", " "), (SP + "+", ""))


def name_quality(x: str) -> str:
    return rr(f"lower({clean(x)})", (BR, ""), (
        "上海市?|苏州市?|嘉兴市?|南通市?|无锡市?|镇江市?|社区|街道|乡|镇|文化活动中心|文化中心|服务中心|分馆|馆", ""), (PUNCT, ""))


def name_notes(x: str) -> str:
    return rr(f"lower({clean(x)})", (r"[（）()【】\[\]]", ""), (
        "上海市?|区|县|社区|街道|乡|镇|党群服务中心|文化活动中心|文化中心|服务中心|图书馆|分馆|馆|长者|老年|食堂|助餐点", ""), (PUNCT, ""))


def name_dedupe(x: str) -> str:
    return rr(f"lower(coalesce({x}, ''))", ("上海市?", ""), (BR, ""), (r"[\s·•,，.。:：;；/\\_\-—&]", ""))


def addr_quality(x: str) -> str:
    return rr(clean(x), (CITY, ""), (RB, ""), (r"[，,。.、:：;；/\\_\-—]", ""))


def addr_dedupe(x: str) -> str:
    return rr(name_dedupe(x), ("中国|上海市", ""), ("号楼", "号"))


def district(x: str) -> str:
    return f"regexp_extract({clean(x)}, {q('|'.join(dims.DISTRICTS))}, 0)"


def road_first(x: str) -> str:
    """First road + number (+ lane) of an address."""
    base = rr(clean(x), (CITY, ""), (r"[，,。.、:：;；\\_—]", ""), ("临时服务点[:：]?", ""))
    part = lambda i: f"regexp_extract({base}, {q(ROAD)}, {i})"
    road = rr(part(1), ("^.*?(?:区|县)", ""), ("^.*?(?:街道|镇|乡)", ""), ("公路$|大道$", "路"))
    return f"({road} || {part(2)} || CASE WHEN {part(4)} <> '' THEN '弄' || {part(4)} ELSE '' END)"


def street_last(x: str) -> str:
    hits = f"regexp_extract_all(regexp_replace(coalesce({x}, ''), '\\s', '', 'g'), {q(dims.STREET_NUMBER)}, 0)"
    return f"coalesce(list_extract({hits}, -1), '')"


def alnum(x: str) -> str:
    return rr(f"lower(coalesce({x}, ''))", (r"[^0-9a-z\x{4e00}-\x{9fff}]+", ""))


def meters(a1, o1, a2, o2) -> str:
    h = f"least(1e0, pow(sin(radians(({a2}) - ({a1})) / 2), 2) + cos(radians({a1})) * cos(radians({a2})) * pow(sin(radians(({o2}) - ({o1})) / 2), 2))"
    return f"(6371000e0 * 2 * atan2(sqrt({h}), sqrt(1 - {h})))"


def rnd(x: str) -> str:
    return f"CAST(floor(({x}) + 0.5) AS BIGINT)"


def box(lat, lon, b) -> str:
    s, n, w, e = b
    return f"({lat} BETWEEN {s}e0 AND {n}e0 AND {lon} BETWEEN {w}e0 AND {e}e0)"


def issue_list(lat="latitude", lon="longitude") -> list[tuple[str, str]]:
    c, a = clean("name"), clean("address")
    institution = dims.INSTITUTION.replace("政府(?!路)", "政府")
    library = f"{c} LIKE '%图书馆%'"
    none = " OR ".join(box(lat, lon, b) for b in dims.CITY_BOXES.values())
    located = f"({like(a, dims.ADDRESS_LOCATOR)} OR (category = '自然' AND {like(a, dims.NATURE_LOCATOR)}))"
    return [
        ("missing_name", f"{c} = ''"), ("missing_address", f"{a} = ''"),
        ("unsupported_category", "category NOT IN ('图书馆', '食堂', '自然')"),
        ("missing_district", f"{district('address')} = ''"),
        ("missing_street_number", f"{road_first('address')} = '' AND NOT {located}"),
        ("invalid_coordinates", f"{lat} IS NULL OR {lon} IS NULL"),
        ("outside_supported_city_bounds", f"{lat} IS NOT NULL AND {lon} IS NOT NULL AND NOT ({none})"),
        ("school_library", f"category = '图书馆' AND {like(c, dims.SCHOOL)}"),
        # RE2 has no look-ahead: 政府路 is hidden first
        ("restricted_institution", like(f"replace({c}, '政府路', '#')", institution)),
        ("excluded_place_type", f"{c} = '阅闲坊' OR ({like(c, dims.EXCLUDED_ROOM + '|' + dims.EXCLUDED_PARTY)} AND NOT {library})"),
        ("ineligible_canteen", f"category = '食堂' AND NOT ({like(c, dims.CANTEEN_ALLOW['quality'])} AND NOT {like(c, dims.CANTEEN_DENY)})"),
        ("ineligible_nature_place", f"category = '自然' AND NOT ({like(c, dims.NATURE_ALLOW + '|' + dims.NATURE_FREE_NAMES)} AND NOT {like(c, dims.NATURE_DENY)})"),
    ]


def code_list(pairs) -> str:
    """Comma-joined codes of the conditions that hold."""
    return "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in pairs) + "], lambda x: x IS NOT NULL), ',')"


def case(pairs, other="''") -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN '{n}'" for n, c in pairs) + f" ELSE {other} END"
