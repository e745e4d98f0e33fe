"""URL keys, stable ids and row fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from placeloom import dims
from placeloom.functions.text import col, text


# scheme, authority, path, query of a URL in one pass; a plain pattern, because a parser that rejects odd URLs loses them
_URL = r"(?s)^(?:([^:/?#]+):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?.*$"
_PARTS = {"PROTOCOL": 0, "AUTHORITY": 1, "PATH": 2, "QUERY": 3}


class Parts(str):
    """Name of a column of url_parts; the functions below take it for the URL, which is then parsed once."""


def url_parts(url) -> Column:
    return F.split(F.regexp_replace(text(url), _URL, "$1\u0001$2\u0001$3\u0001$4"), "\u0001")


def _part(url, name: str) -> Column:
    return F.get(F.col(url) if isinstance(url, Parts) else url_parts(url), F.lit(_PARTS[name]))


def url_scheme(url) -> Column:
    return F.lower(_part(url, "PROTOCOL"))


def url_host(url) -> Column:
    return F.lower(_part(url, "AUTHORITY"))


def _pairs(url) -> Column:
    """Query pairs as written, each with an '='; sorted as an array because a map would lose repeated keys."""
    raw = F.filter(F.split(_part(url, "QUERY"), "&"), lambda v: v != "")
    return F.transform(raw, lambda v: F.when(v.contains("="), v).otherwise(F.concat(v, F.lit("="))))


def request_key(url) -> Column:
    """Equal for two URLs that ask for the same page."""
    path = F.rtrim(_part(url, "PATH"), F.lit("/"))
    return F.concat_ws("\u0001", url_scheme(url), url_host(url), path, F.array_join(F.array_sort(_pairs(url)), "&"))


def canonical_url(url) -> Column:
    u = F.trim(text(url))
    query = F.array_join(F.array_sort(_pairs(u)), "&")
    path = F.rtrim(_part(u, "PATH"), F.lit("/"))
    out = F.concat(url_scheme(u), F.lit("://"), url_host(u), path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when(url_host(u) == "", F.lit("")).otherwise(out)


def source_url(url) -> Column:
    """http(s) URL without tracking parameters and fragment; '' for anything else."""
    kept = F.filter(_pairs(url), lambda v: ~F.lower(F.substring_index(v, "=", 1)).isin(dims.TRACKING_KEYS))
    query = F.array_join(kept, "&")
    out = F.concat(url_scheme(url), F.lit("://"), url_host(url), _part(url, "PATH"),
                   F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))
    return F.when(url_scheme(url).isin("http", "https") & (url_host(url) != ""), out).otherwise(F.lit(""))


def bare_domain(url) -> Column:
    return F.regexp_replace(url_host(url), r"^www\.", "")


def domain_in(url, domains=dims.EXCLUDED_DOMAINS) -> Column:
    """Host equal to one of the domains or below it."""
    names = "|".join(d.replace(".", r"\.") for d in domains)
    return url_host(url).rlike(rf"(?:^|\.)(?:{names})$")


def usable_source(url) -> Column:
    """source_url, or NULL when there is none or its domain is excluded."""
    return F.when((url_host(url) != "") & ~domain_in(url), F.nullif(source_url(url), F.lit("")))


def stable_id(prefix: str, *cols) -> Column:
    joined = F.concat_ws("|", *[text(c) for c in cols])
    return F.concat(F.lit(prefix + "-"), F.substring(F.sha2(joined, 256), 1, 24))


def visitor_id(openid, appid) -> Column:
    app = F.coalesce(F.nullif(col(appid), F.lit("")), F.lit("miniprogram"))
    who = F.coalesce(F.nullif(col(openid), F.lit("")), F.lit("anonymous"))
    return F.sha2(F.concat_ws(":", app, who), 256)


def visitor_code(vid: Column) -> Column:
    return F.upper(F.substring(vid, 1, 6))


def number_text(c) -> Column:
    """Coordinates printed with seven decimals, the form used inside fingerprints."""
    return F.format_string("%.7f", col(c).cast("double"))


FINGERPRINT_FIELDS = ["name", "category", "latitude", "longitude", "address", "hours", "description"]


def place_fingerprint(photo_count, photo_digest) -> Column:
    """sha256 of the seven published fields plus the digest of the ordered photo list."""
    parts = [number_text(f) if f in ("latitude", "longitude") else text(f) for f in FINGERPRINT_FIELDS]
    return F.sha2(F.concat_ws("\u001f", *parts, col(photo_count).cast("string"), col(photo_digest).cast("string")), 256)


def hash60(c: Column) -> Column:
    """15 hex digits of a sha256 as a positive BIGINT."""
    return F.conv(F.substring(F.sha2(c, 256), 1, 15), 16, 10).cast("bigint")


def infer_channel(url, title, snippet) -> Column:
    all_text = F.lower(F.concat_ws(" ", text(url), text(title), text(snippet)))
    host = url_host(url)
    official = host.endswith("gov.cn") | host.contains("library") | (text(title).contains("图书馆") & text(title).contains("官网"))
    bare = F.regexp_replace(host, r"^www\.", "")
    return (
        F.when(all_text.rlike("xiaohongshu|小红书|精选笔记"), "小红书")
        .when(all_text.rlike("dianping|大众点评"), "大众点评")
        .when(all_text.rlike("amap|高德"), "高德")
        .when(all_text.rlike(r"map\.baidu|百度地图"), "百度地图")
        .when(official, "官方")
        .when(host.contains("baidu.com"), "百度")
        .when(bare != "", bare).otherwise("其他网页")
    )
