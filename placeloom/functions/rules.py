"""Admission predicates and record audit codes."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from placeloom import dims
from placeloom.functions import geo
from placeloom.functions.text import clean_text, codes, col, extract_district, road_number, text

RULESETS = ("quality", "admin", "runtime")


def _value(name, ruleset: str) -> Column:
    return clean_text(name) if ruleset == "quality" else text(name)


def is_school(name, ruleset="quality") -> Column:
    return _value(name, ruleset).rlike(dims.SCHOOL)


def is_institution(name, ruleset="quality") -> Column:
    return _value(name, ruleset).rlike(dims.INSTITUTION)


def is_excluded_type(name, ruleset="quality") -> Column:
    v = _value(name, ruleset)
    library = v.contains("图书馆")
    return (v == dims.EXCLUDED_NAME) | (v.rlike(f"{dims.EXCLUDED_ROOM}|{dims.EXCLUDED_PARTY}") & ~library)


def is_public_canteen(name, ruleset="quality") -> Column:
    v = _value(name, ruleset)
    return v.rlike(dims.CANTEEN_ALLOW["quality" if ruleset == "quality" else "admin"]) & ~v.rlike(dims.CANTEEN_DENY)


def is_public_nature(name, ruleset="quality") -> Column:
    v = _value(name, ruleset)
    return (v.rlike(dims.NATURE_ALLOW) | v.rlike(dims.NATURE_FREE_NAMES)) & ~v.rlike(dims.NATURE_DENY)


def record_issues(name="name", category="category", address="address", lat="latitude", lon="longitude") -> Column:
    """Audit codes of one place record, in reporting order."""
    a, cat = clean_text(address), col(category)
    located = a.rlike(dims.ADDRESS_LOCATOR) | ((cat == "自然") & a.rlike(dims.NATURE_LOCATOR))
    good_point = geo.finite(lat, lon)
    return codes([
        ("missing_name", clean_text(name) == ""),
        ("missing_address", a == ""),
        ("unsupported_category", ~F.coalesce(cat, F.lit("")).isin(dims.CATEGORIES)),
        ("missing_district", extract_district(address) == ""),
        ("missing_street_number", (road_number(address) == "") & ~located),
        ("invalid_coordinates", ~good_point),
        ("outside_supported_city_bounds", good_point & (F.size(geo.cities_at(lat, lon)) == 0)),
        ("school_library", (cat == "图书馆") & is_school(name)),
        ("restricted_institution", is_institution(name)),
        ("excluded_place_type", is_excluded_type(name)),
        ("ineligible_canteen", (cat == "食堂") & ~is_public_canteen(name)),
        ("ineligible_nature_place", (cat == "自然") & ~is_public_nature(name)),
    ])


def first_reason(checks) -> Column:
    """Name of the first condition that holds; '' when none does."""
    out = None
    for name, cond in checks:
        out = F.when(cond, F.lit(name)) if out is None else out.when(cond, F.lit(name))
    return out.otherwise(F.lit(""))


def map_poi_reason(name, address, map_category, manual_rejects=()) -> Column:
    """First reject reason of a map discovery; the two checks against existing places are joins and come after."""
    n, a = clean_text(name), clean_text(address)
    scenic_rest = F.regexp_replace(n, "景区", "")
    return first_reason([
        ("non_nature_map_category", ~text(map_category).isin("", "Park", "Beach")),
        ("manual_identity_or_scope_reject", n.isin(list(manual_rejects)) if manual_rejects else F.lit(False)),
        ("weak_type", ~n.rlike(dims.CORE_TYPE)),
        ("excluded_name", n.rlike(dims.REJECT_NAME)),
        ("private_or_subarea_plant_garden", n.rlike(dims.PRIVATE_PLANT)),
        ("private_ecological_venue", n.rlike("(?<!公)生态园$")),
        ("cultural_scenic_area", n.rlike("景区$") & ~scenic_rest.rlike(dims.NATURAL_SCENIC)),
        ("ambiguous_natural_feature", (F.length(n) <= 3) & n.rlike("(?:山|湖|岛|洲|滩|谷|岭|峰|森林)$")),
        ("sub_poi", n.rlike(dims.SUB_POI) | a.rlike(dims.SUB_POI)),
        ("road_intersection", n.rlike("与.+交叉口")),
    ])


def note_title_ok(category, title) -> Column:
    return _by_category(category, {
        k: text(title).rlike(need) & ~text(title).rlike(deny) for k, (need, deny) in dims.NOTE_TITLE.items()})


def note_body_ok(category, body) -> Column:
    b = text(body)
    return _by_category(category, {
        k: b.rlike(need) & (b.rlike(also) if also else F.lit(True)) & ~b.rlike(deny)
        for k, (need, also, deny) in dims.NOTE_BODY.items()})


def _by_category(category, rules) -> Column:
    return F.when(col(category) == "图书馆", rules["图书馆"]).otherwise(rules["食堂"])


def curated_description_issues(name, description) -> Column:
    d = text(description)
    return codes([
        ("empty_or_padded", (d == "") | (F.trim(d) != d)),
        ("trailing_punctuation", d.rlike(dims.CURATED_TRAILING)),
        ("channel_name", d.rlike(dims.CURATED_CHANNEL)),
        ("generic_activity", d.rlike(dims.CURATED_GENERIC)),
        ("place_name_in_text", (text(name) != "") & d.contains(text(name))),
    ])


def curated_hours_issues(hours) -> Column:
    h = text(hours)
    return codes([
        ("empty_or_padded", (h == "") | (F.trim(h) != h)),
        ("onsite_notice", h.contains("现场公示")),
        ("no_explicit_time", ~h.rlike(r"\d{1,2}:\d{2}")),
    ])
