"""Page text, mentions and evidence lines."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window, functions as F

from placeloom import dims
from placeloom.functions import text as T
from placeloom.operators.grams import bit_table, grams_in
from placeloom.operators.scale import first_per_key, keep_value, skew_join, spread, top_k
from placeloom.session import cut_lineage

GRAM = 4
SIZES = 4  # lengths of runs: GRAM, twice, four and eight times as many letters


def page_lines(pages: DataFrame, body: str = "text", keep: list[str] = ()) -> DataFrame:
    """(page_id, *keep, line_no, line): cleaned non-empty lines with their 1-based number."""
    pieces = F.posexplode(F.split(T.text(body), "\n"))
    lines = spread(pages).select("page_id", *keep, pieces.alias("i", "raw"))
    return lines.select("page_id", *keep, (F.col("i") + 1).alias("line_no"), T.clean_markdown("raw").alias("line")).where("line <> ''")


def with_context(pages: DataFrame, body: str = "text") -> DataFrame:
    """(page_id, line_no, line, context): every non-empty line with the raw lines next to it.

    The lines meet their neighbours as shifted arrays of the same page, so no window is needed.
    """
    raw = spread(pages).select("page_id", F.transform(F.split(T.text(body), "\n"), T.clean_markdown).alias("ls"))
    blank, n = F.array(F.lit("")), F.size("ls") - 1
    before = F.concat(blank, F.slice("ls", F.lit(1), n))
    after = F.concat(F.slice("ls", F.lit(2), n), blank)
    rows = raw.select("page_id", F.posexplode(F.arrays_zip(before.alias("a"), F.col("ls").alias("b"), after.alias("c"))).alias("i", "t"))
    ctx = F.concat_ws(" ", *[F.nullif(F.col(f"t.{c}"), F.lit("")) for c in "abc"])
    return rows.where("t.b <> ''").select("page_id", (F.col("i") + 1).alias("line_no"), F.col("t.b").alias("line"), ctx.alias("context"))


def mentions(pages: DataFrame, aliases: DataFrame, gram: int = GRAM) -> DataFrame:
    """(page_id, place_id): pages(page_id, key) that contain an alias(place_id, alias) of at least `gram` letters.

    An alias occurs only where each of its n-grams occurs, so any one of them may serve as its meeting key: runs of 4, 8,
    16 or 32 letters, the longest size that fits, since long runs seldom meet in vain. The one that is rarest in a sample
    of the pages is taken (the sample only picks the key, it leaves out no page). Pages are scanned against a bit table
    of these runs, so a page without one gives no rows, and every meeting is tested on the whole page text. NULL keys
    and aliases meet nothing.
    """
    names = aliases.where(F.length("alias") >= gram).select("alias").distinct()
    alias_grams = cut_lineage(grams_in(names.withColumn("key", F.col("alias")), "alias", "key", gram, SIZES, longest=True))
    # the lowest twentieth of the hash range: unlike sample(), this filter sinks below the text normalisation
    some = spread(pages.where(F.xxhash64("page_id") < F.lit(int(-0.9 * 2**63))))
    df = grams_in(some, "page_id", "key", gram, SIZES, bit_table(alias_grams)).groupBy("gram").agg(F.count(F.lit(1)).alias("df"))
    rare = alias_grams.join(df, "gram", "left").groupBy("alias").agg(
        F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), F.col("gram"))).alias("m"))
    probe = cut_lineage(rare.select("alias", F.col("m.gram").alias("gram")))
    index = grams_in(spread(pages), "page_id", "key", gram, SIZES, bit_table(probe))
    met = cut_lineage(skew_join(index, probe, ["gram"]).select("page_id", "alias").distinct())
    # the whole text is needed, and normalised again, only for pages that met an alias
    asked = pages.select("page_id", "key").join(met.select("page_id").distinct(), "page_id", "left_semi")
    hit = skew_join(met, asked, ["page_id"]).where(F.col("key").contains(F.col("alias"))).select("page_id", "alias")
    return skew_join(hit, aliases.select("place_id", "alias").distinct(), ["alias"]).select("page_id", "place_id").distinct()


def evidence_kinds(context: Column, is_source: Column, terms: list[str] = dims.FACILITY_TERMS) -> Column:
    """Kinds of evidence a context holds: address, hours, facility."""
    found = F.lower(context).rlike("|".join(re.escape(t) for t in terms))
    return T.codes([
        ("address", context.rlike(dims.ADDRESS_CONTEXT) & context.rlike(dims.ADDRESS_VALUE) & (is_source | context.rlike(dims.ADDRESS_ASSERTION))),
        ("hours", holds_hours(context, is_source)),
        ("facility", found & (is_source | context.rlike(dims.FACILITY_ASSERTION))),
    ])


def holds_hours(context: Column, is_source: Column) -> Column:
    return context.rlike(dims.TIME_CONTEXT) & context.rlike(dims.TIME_VALUE) & (is_source | context.rlike(dims.HOURS_ASSERTION))


def text_digest(key: Column) -> Column:
    """SHA-256 of a normalised text, 32 bytes that stand for it in comparisons; NULL for an empty one."""
    return F.when(key != "", F.unhex(F.sha2(key, 256)))


def cap_evidence(
    rows: DataFrame, keys: list[str], order: list, cap: int, text_col: str = "context", compared: int | None = None, digest: str | None = None
) -> DataFrame:
    """First `cap` rows per key with different normalised text; `compared` limits the comparison to leading characters.

    Texts are compared by their digests. With `digest`, a column made by text_digest, rows need not carry the text.
    """
    if digest is None:
        text = F.col(text_col) if compared is None else F.substring(text_col, 1, compared)
        rows = keep_value(rows, "_key", text_digest(T.alnum_key(text)))
    else:
        rows = keep_value(rows, "_key", F.col(digest))
    uniq = first_per_key(rows, [*keys, "_key"], order)
    return top_k(uniq, keys, order, cap, "rank").drop("_key")


def block_score(terms_found: Column, longest_alias: Column, text: Column) -> Column:
    sources = sum((F.when(F.lower(text).contains(t.lower()), 4).otherwise(0) for t in dims.SOURCE_TERMS), F.lit(0))
    dated = F.when(text.rlike(r"20\d{2}年|20\d{2}[-/.]"), 4).otherwise(0)
    baidu = (F.length(text) - F.length(F.regexp_replace(text, "百度", ""))) / 2
    return terms_found * 7 + longest_alias + sources + dated - F.greatest(F.lit(0), baidu.cast("int") - 2) * 2


# ---- relevance scores -------------------------------------------------------------

def count_terms(value: Column, terms: list[str]) -> Column:
    return count_in(F.lower(value), terms)


def count_in(low: Column, terms: list[str]) -> Column:
    return sum((low.contains(t).cast("int") for t in terms), F.lit(0))


def with_source_score(rows: DataFrame, names: DataFrame, text, title, terms: list[str] = dims.FIELD_TERMS) -> DataFrame:
    """rows(place_id, host, ...) joined with names(place_id, name), and their score. A name's keys are made once a place,
    a text is lower-cased once a row."""
    keyed = names.select("place_id", "name", T.alnum_key("name").alias("_full"),
                         T.alnum_key(T.sub(T.text("name"), ("[（）()]", ""))).alias("_flat"), T.alnum_key(T.sub(T.text("name"), (T.ROUND_BRACKETS, ""))).alias("_bare"))
    met = skew_join(rows, keyed, ["place_id"])
    met = met.withColumn("_low", F.lower(F.concat_ws(" ", T.text(text), T.text(title)))).withColumn("_key", T.sub("_low", (T.NOT_WORD, "")))
    return met.withColumn("score", _source_points(F.col("host"), terms)).drop("_full", "_flat", "_bare", "_low", "_key")


def _source_points(host: Column, terms: list[str]) -> Column:
    low, key, full, flat, bare = (F.col(c) for c in ("_low", "_key", "_full", "_flat", "_bare"))
    name = (F.when((full != "") & key.contains(full), 90).when((flat != "") & key.contains(flat), 70)
            .when(key.contains(bare), 30).otherwise(0))
    pts = lambda cond, n: F.when(cond, n).otherwise(0)
    return (
        count_in(low, terms) * 9 + name
        + pts(host.endswith("gov.cn") | host.contains(".gov.cn"), 100)
        + pts(host.contains("library") | host.endswith("sh.cn"), 70)
        + pts(host.rlike(r"xiaohongshu|dianping|weibo|amap|map\.qq"), 55)
        + pts(host.contains("mp.weixin.qq.com"), 45)
        + pts(host.rlike(r"thepaper|shobserver|xinmin|163\.com"), 30)
        - pts(key == "", 80)
    )


def facility_source_score(url, host: Column, channel: Column, title, snippet, position, terms: list[str]) -> Column:
    body = F.concat_ws(" ", T.text(title), T.text(snippet))
    pts = lambda cond, n: F.when(cond, n).otherwise(0)
    u = F.col(url) if isinstance(url, str) else url
    return (
        count_terms(body, terms) * 8 + pts(host.endswith("gov.cn") | host.contains("library"), 80)
        + pts(channel.isin("小红书", "大众点评"), 45) + pts(channel.isin("高德", "百度地图"), 25)
        + pts(T.text(title).rlike("官方|服务"), 25) - pts(u.rlike(r"zhidao\.baidu\.com|wenku\.baidu\.com"), 40)
        - F.coalesce(F.col(position), F.lit(10))
    )


def title_rank(name, category, title) -> Column:
    a, b = T.normalize_name(name, "notes"), T.normalize_name(title, "notes")
    pts = lambda cond, n: F.when(cond, n).otherwise(0)
    cat = F.col(category)
    return (
        pts(T.text(title).contains(T.text(name)), 120) + pts((a != "") & (a == b), 100)
        + pts((F.least(F.length(a), F.length(b)) >= 3) & T.contains_either(a, b), 70)
        + pts((cat == "图书馆") & T.text(title).rlike("图书馆|阅读空间"), 15) + pts((cat == "食堂") & T.text(title).rlike("食堂|助餐"), 15)
    )


def body_match(name, address, title, body) -> dict[str, Column]:
    """Score of a note against a place: full name, normalised name, door number, district; accepted at 80."""
    full = F.concat_ws("\n", T.text(title), T.text(body))
    compact, place = T.normalize_name(full, "compact"), T.normalize_name(name, "compact")
    norm, norm_place = T.normalize_name(full, "notes"), T.normalize_name(name, "notes")
    door = T.sub(T.clean_text(address), ("^上海市?", ""))
    pattern = r"([^区县,，。；;]{1,30}(?:公路|大道|路|街|道|弄|巷|村))(\d+)(?:弄(\d+))?号?"
    door = F.regexp_replace(F.regexp_extract(door, pattern, 0), f"^{pattern}$", "$1$2$3")  # one search of the address, not three
    names = "|".join(dims.SHANGHAI_DISTRICTS)
    own = F.regexp_extract(T.clean_text(address), names, 0)
    seen = F.regexp_extract_all(full, F.lit(f"({names})"), F.lit(1))
    by_name = (place != "") & compact.contains(place)
    by_door = (door != "") & T.clean_text(full).contains(door)
    by_district = (own != "") & F.array_contains(seen, own)
    wrong = (F.size(seen) > 0) & (own != "") & ~F.array_contains(seen, own)
    score = (
        F.when(by_name, 120).otherwise(0)
        + F.when((F.length(norm_place) >= 3) & norm.contains(norm_place), 80).otherwise(0)
        + F.when(by_door, 120).otherwise(0) + F.when(by_district, 15).otherwise(0)
        - F.when(wrong & ~by_name & ~by_door, 100).otherwise(0)
    )
    return {"match_score": score, "accepted": (F.trim(T.text(body)) != "") & (score >= 80)}


def place_score(name, category, address, haystack_source, city: str) -> Column:
    hay = T.alnum_key(haystack_source)
    branch = T.alnum_key(F.when(F.col(category) == "自然", T.nature_base_name(name)).otherwise(T.branch_name(name)))
    terms = F.filter(T.address_terms(address, city), lambda t: hay.contains(T.alnum_key(t)))
    cat = F.col(category)
    pts = lambda cond, n: F.when(cond, n).otherwise(0)
    return (
        pts(hay.contains(T.alnum_key(name)), 30) + pts((F.length(branch) >= 2) & hay.contains(branch), 24)
        + pts(hay.contains(T.alnum_key(F.lit(city))), 3) + F.size(terms) * 8
        + pts((cat == "图书馆") & hay.contains("图书馆"), 3) + pts((cat == "食堂") & hay.rlike("食堂|助餐|小厨"), 3)
        + pts((cat == "自然") & hay.rlike("公园|绿地|滨水|风景|湿地|绿道|步道"), 3)
    )


# ---- page structure ------------------------------------------------------------------

def html_links(pages: DataFrame, html: str = "html") -> DataFrame:
    """(page_id, position, href, label): anchors in page order."""
    pattern = r"""(?is)<a\b[^>]*?\bhref\s*=\s*["']([^"']*)["'][^>]*>(.*?)</a>"""
    href = F.regexp_extract_all(T.text(html), F.lit(pattern), F.lit(1))
    label = F.regexp_extract_all(T.text(html), F.lit(pattern), F.lit(2))
    rows = pages.select("page_id", F.posexplode(F.arrays_zip(href.alias("href"), label.alias("label"))).alias("i", "m"))
    return rows.select("page_id", (F.col("i") + 1).alias("position"), unescape(F.col("m.href")).alias("href"), html_text(F.col("m.label")).alias("label"))


def html_text(c) -> Column:
    """Visible text: scripts, styles, comments and tags removed, entities resolved, white space squeezed."""
    return T.squeeze(unescape(T.sub(
        T.text(c), (r"(?is)<(script|style)\b.*?</\1\s*>", " "), (r"(?s)<!--.*?-->", " "), (r"(?s)<[^>]*>", " "))))


def unescape(c: Column) -> Column:
    return T.sub(c, ("&nbsp;|&#160;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;|&#34;", '"'), ("&#39;|&apos;", "'"), ("&amp;", "&"))


def html_headings(pages: DataFrame, html: str = "html") -> DataFrame:
    """(page_id, block, level, heading, snippet): headings with the visible text up to the next heading."""
    parts = F.split(T.text(html), r"(?i)(?=<h[1-6]\b)")
    rows = pages.select("page_id", F.posexplode(parts).alias("block", "part")).where(F.col("part").rlike(r"(?i)^<h[1-6]\b"))
    return rows.select(
        "page_id", "block", F.regexp_extract("part", r"(?i)^<h([1-6])", 1).cast("int").alias("level"),
        html_text(F.regexp_extract("part", r"(?is)^<h[1-6][^>]*>(.*?)</h[1-6]>", 1)).alias("heading"),
        html_text(T.sub(F.col("part"), (r"(?is)^<h[1-6][^>]*>.*?</h[1-6]>", ""))).alias("snippet"))


def html_table_rows(pages: DataFrame, html: str = "html") -> DataFrame:
    """(page_id, row_no, section, cells): table rows; a one-cell row opens a section that the rows below carry."""
    trs = F.regexp_extract_all(T.text(html), F.lit(r"(?is)<tr\b[^>]*>(.*?)</tr>"), F.lit(1))
    rows = pages.select("page_id", F.posexplode(trs).alias("row_no", "tr"))
    cells = F.transform(F.regexp_extract_all("tr", F.lit(r"(?is)<t[dh]\b[^>]*>(.*?)</t[dh]>"), F.lit(1)), html_text)
    rows = rows.select("page_id", "row_no", cells.alias("cells"))
    head = F.when(F.size("cells") == 1, F.col("cells")[0])
    w = Window.partitionBy("page_id").orderBy("row_no")  # one page's rows
    out = rows.withColumn("section", F.coalesce(F.last(head, ignorenulls=True).over(w), F.lit("")))
    return out.where(F.size("cells") > 1).select("page_id", "row_no", "section", F.array_join("cells", "|").alias("cells"))


def markdown_results(pages: DataFrame, body: str = "text", cap: int = 12) -> DataFrame:
    """'### [title](url)' blocks with the text lines below each, first `cap` per page."""
    blocks = F.split(T.text(body), r"(?m)(?=^### )")
    rows = pages.select("page_id", F.posexplode(blocks).alias("block", "part")).where(F.col("part").rlike(r"^### \[.+?\]\(https?://[^)]+\)"))
    rows = rows.select(
        "page_id", "block", T.clean_markdown(F.regexp_extract("part", r"^### \[(.+?)\]\(", 1)).alias("title"),
        F.regexp_extract("part", r"^### \[.+?\]\((https?://[^)]+)\)", 1).alias("url"),
        T.clean_markdown(T.sub(F.col("part"), (r"^### [^\n]*\n?", ""))).alias("snippet"))
    return top_k(rows, ["page_id"], ["block"], cap, "position").drop("block")


def json_lists(c, field: str) -> Column:
    """JSON arrays written after "field": inside a page, as strings."""
    return F.regexp_extract_all(T.text(c), F.lit(rf'(?s)"{field}":\s*(\[\{{.*?\}}\])'), F.lit(1))


def reverse_references(refs: DataFrame) -> DataFrame:
    """(url, kind, place_id, page_id): who refers to a url; a proxy url also yields the url it wraps.

    Kept as distinct flat rows: one url may be referred to by a large share of all pages.
    """
    from placeloom.functions import keys as K

    nested = F.filter(F.split(F.coalesce(F.try_parse_url("url", F.lit("QUERY")), F.lit("")), "&"), lambda v: v.startswith("url="))
    inner = F.try_url_decode(F.substr(F.try_element_at(nested, F.lit(1)), F.lit(5)))
    proxied = F.when(K.url_host("url").contains("sogoucdn.com") & inner.rlike("^https?://"), inner)
    both = F.array_compact(F.array(
        F.struct(F.col("url").alias("u"), F.lit("extracted").alias("k")),
        F.when(proxied.isNotNull(), F.struct(proxied.alias("u"), F.lit("proxy-original").alias("k")))))
    rows = refs.where(F.col("url").rlike("^https?://")).withColumn("_r", F.explode(both))
    return rows.select(F.col("_r.u").alias("url"), F.col("_r.k").alias("kind"), "place_id", "page_id").distinct()


def query_plan(places: DataFrame, templates: list[tuple[str, str, str]]) -> DataFrame:
    """Place × channel rows with query text and request URL; the templates are an array in each row, so nothing is joined."""
    name = T.squeeze(T.sub(T.text("name"), ("[（）()]", " "), ("[“”]", "")))
    rows = []
    for channel, base, pattern in templates:
        parts = [F.lit(p) if not p.startswith("{") else {"{name}": name, "{category}": F.col("category")}[p]
                 for p in re.split(r"(\{name\}|\{category\})", pattern) if p]
        q = F.concat(*parts)
        rows.append(F.struct(F.lit(channel).alias("channel"), q.alias("query"), F.concat(F.lit(base), F.url_encode(q)).alias("url")))
    return places.select("id", F.explode(F.array(*rows)).alias("r")).select("id", "r.*")
