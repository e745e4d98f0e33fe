"""Main text of web pages by equivalence classes of template tokens.

Tokens are a page's elements. A token's role is its path of containers, each named by tag, class and role words and by its number
among the equally named children of its container, so that equal names in different places are different roles. A role's occurrence
vector says on which of its host's distinct pages it stands. Roles with equal vectors form a class. A class is part of a
template if it stands on at least `min_pages` pages and `SUPPORT` of the host's pages: the root class (on every page) is what all
pages share, smaller ones are the templates of a part of the pages, or optional boxes. Vectors are compared by a sum of page hashes, so they
are never gathered, however many pages a host has.

Classes nest by their paths. A class is valid under a template element if its members there come in the same order on every page that
has them; members that do not are no template, and their text belongs to the element around them. Each text belongs to the deepest
template element on its path, its slot. A slot whose text is the same on all pages is template text; what differs is content, unless it is
mostly links.

What no vector can tell is told by names: parts under menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles
and reader comments are never content, and where a page's template has article or main slots, those are the content, whole. Names count
only if all their parts say so (`share-bar` does, `share-ready` does not), never on html, body or main elements, and few on articles.
Pages whose host has fewer than `min_pages` distinct pages, or that have no text in any slot, are decided by their own elements in that order. An article that is the same on all pages is template if
another one differs.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from placeloom.llm.common import cut_lineage, text_batches

MIN_PAGES = 3  # a template class, and a text that is template, stands on at least so many pages
SUPPORT = 0.05  # and a class on this share of the host's pages, which bounds a host's template by the size of its pages

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|iframe|svg|textarea|select|button)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>.*?(?:</\1\s*>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<[!?/][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>",
    re.S | re.I)
_NAMES = re.compile(r"(?:^|\s)(class|id|role|itemprop)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORDS = re.compile(r"[a-z]+")

# Fixed word lists: what HTML elements are, and how pages name their parts.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
LEAF = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th tr tbody thead tfoot caption pre blockquote figcaption option".split())
CLOSED_BY_SIBLING = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
BOILERPLATE_TAGS = frozenset("nav footer aside form head title menu dialog fieldset script style noscript template iframe".split())
BOILERPLATE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar menu nav navbar navigation breadcrumb breadcrumbs "
    "notice notices cookie cookies consent gdpr popup modal newsletter subscribe subscription share sharing social related recommended recommendations "
    "comment comments reply replies respond discussion disqus footer pagination pager login signup search widget".split())
HEADER_WORDS = frozenset("header masthead topbar toolbar".split())
# words that say nothing in a compound name such as post-comments or ad-slot
HOLDER_WORDS = frozenset(
    "area articles bar block body bottom box button buttons col column container content footer frame global group header holder inner item items js left link links list "
    "main message outer page panel post posts primary right row secondary section side site slot stories text top unit wrap wrapper".split())
MAIN_TAGS = frozenset(("article", "main"))
MAIN_WORDS = frozenset(("articlebody",))
NEVER_NAMED = frozenset(("html", "body", "main"))  # elements that names do not make boilerplate
ARTICLE_WORDS = frozenset("ad ads advert comment comments related reply replies teaser teasers".split())  # names of articles that are not the page's


def _says(name: str, words: frozenset[str]) -> bool:
    """Whether a class name consists of such words, and others that say nothing beside them."""
    parts = _WORDS.findall(name)
    return any(w in words for w in parts) and all(w in words or w in HOLDER_WORDS or w in BOILERPLATE_WORDS for w in parts)


class _Box:
    __slots__ = ("tag", "role", "up", "kids", "main", "junk", "form", "slot")  # main: role of the outermost article or main element around

    def __init__(self, up: "_Box | None", tag: str, attributes: str):
        self.tag, self.up, self.kids, self.slot = tag, up, {}, None
        words, names = [], []
        if "=" in attributes:
            for m in _NAMES.finditer(attributes):
                value = (m[2] or m[3] or m[4] or "").lower()
                names += value.split()
                if m[1].lower() != "id":  # ids are often a page's own
                    words += _WORDS.findall(value)
        signature = ".".join([tag, *dict.fromkeys(words)])
        if up is None:
            self.role = 0
        else:
            number = up.kids[signature] = up.kids.get(signature, -1) + 1
            self.role = xxhash.xxh64_intdigest(f"{up.role}>{signature}>{number}".encode("utf-8", "surrogatepass")) >> 1
        self.main = up and up.main or (self.role if tag in MAIN_TAGS or any(w in MAIN_WORDS for w in words) else None)
        named, parts = tag not in NEVER_NAMED, ARTICLE_WORDS if tag == "article" else BOILERPLATE_WORDS
        header = (tag == "header" or named and any(_says(n, HEADER_WORDS) for n in names)) and not self.main
        self.junk = up is not None and up.junk or tag in BOILERPLATE_TAGS or header or named and any(_says(n, parts) for n in names)
        self.form = up is not None and up.form or tag == "form"


def walk(html: str) -> Iterator[tuple[str, _Box, str, bool]]:
    """Events of a page: ("open", box, "", False), ("text", box, raw text, inside a link), ("break", box, "", False).

    Boxes are containers; paragraphs, headings, list items and table parts only break the text, inline elements do nothing.
    End tags without a start are passed over, and what stays open is closed with its container.
    """
    root = _Box(None, "#", "")
    stack, links, at = [root], 0, 0
    yield "open", root, "", False
    for m in _TOKEN.finditer(html):
        if m.start() > at:
            yield "text", stack[-1], html[at:m.start()], links > 0
        at = m.end()
        tag = m[3] or m[6]
        if not tag:
            continue
        tag, closing = tag.lower(), m[2] or m[5]
        if tag == "a":
            links = 0 if closing else 1
        elif tag == "br" or tag in ("td", "th"):
            yield "text", stack[-1], " ", links > 0
        elif tag in INLINE or tag in VOID and tag != "hr":
            pass
        elif tag in LEAF or tag == "hr":
            links = 0
            yield "break", stack[-1], "", False
        elif closing:
            links = 0
            yield "break", stack[-1], "", False
            depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag), 0)
            if depth:
                del stack[depth:]
        else:
            links = 0
            yield "break", stack[-1], "", False
            box = _Box(stack[-1], tag, m[4] or m[7] or "")
            yield "open", box, "", False
            if not (m[4] or m[7] or "").endswith("/"):
                stack.append(box)
    if at < len(html):
        yield "text", stack[-1], html[at:], links > 0


def _events(html: str, template) -> Iterator[tuple[str, _Box, str, bool]]:
    """Events of a page whose boxes know their slot, the deepest role of the template on their path."""
    for event in walk(html):
        box = event[1]
        if event[0] == "open":
            box.slot = box.role if box.role in template else box.up.slot if box.up else None
        yield event


def extract(html: str, template: dict[int, int]) -> str:
    """Blocks of the page's content, joined by line ends; `template` says of each role what its slot is: MAIN, SAME, CONTENT or OTHER."""

    def blocks(wanted) -> list[str]:
        out, now = [], []
        for kind, box, raw, _ in events:
            if kind == "text":
                if wanted(box):
                    now.append(raw)
            elif now:
                out.append("".join(now))
                now = []
        out.append("".join(now))
        return [t for t in (" ".join(entities.unescape(b).split()) for b in out) if t]

    events = list(_events(html, template))
    tries = [lambda b: b.main and not b.junk, lambda b: not b.junk, lambda b: b.form and not _junk_without_form(b)]
    if template:
        tries = [lambda b: b.main and template.get(b.slot) != SAME and not b.junk, lambda b: template.get(b.slot) == CONTENT and not b.junk, *tries]
    return "\n".join(next(filter(None, map(blocks, tries)), []))


def _junk_without_form(box: _Box) -> bool:
    """Whether the box is boilerplate for another reason than a form that holds it: a page may stand in one form as a whole."""
    while box.up and box.junk:
        if box.tag != "form" and not box.up.junk:
            return True
        if box.tag in BOILERPLATE_TAGS and box.tag != "form":
            return True
        box = box.up
    return False


OTHER, CONTENT, MAIN, SAME = 0, 1, 2, 3  # SAME: in an article or main element that is alike on all pages


def _page(html: str) -> int:
    return xxhash.xxh64_intdigest(html.encode("utf-8", "surrogatepass"), 1) >> 1


def _rows(batches: Iterator[pa.RecordBatch], schema: pa.Schema, of) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [r for row in batch.to_pylist() if row["html"] and not row["html"].isspace() for r in of(row)]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def token_classes(pages: DataFrame) -> DataFrame:
    """(host, role, klass, pages, n) of pages(host, html): each role with its class and its number of distinct pages, of n of the host."""
    schema = pa.schema([("host", pa.string()), ("page", pa.int64()), ("role", pa.int64())])

    def of(row):
        page = _page(row["html"])
        return [(row["host"], page, box.role) for kind, box, _, _ in walk(row["html"]) if kind == "open"]

    # copies of a page count once
    t = text_batches(pages).mapInArrow(lambda b: _rows(b, schema, of), "host string, page long, role long").distinct()
    t = t.groupBy("host", "role").agg(F.count("*").alias("pages"), F.sum(F.col("page").cast("decimal(38,0)")).alias("vector"))
    t = cut_lineage(t)  # read twice
    n = t.where("role = 0").select("host", F.col("pages").alias("n"))
    return t.join(n, "host").select("host", "role", F.xxhash64("pages", "vector").alias("klass"), "pages", "n")


def templates(classes: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, template): the roles of each host's frequent classes, with their class."""
    t = classes.where((F.col("pages") >= min_pages) & (F.col("pages") >= SUPPORT * F.col("n")))
    return t.groupBy("host").agg(F.collect_list(F.struct("role", "klass")).alias("template"))


def content_slots(pages: DataFrame, found: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """(host, slots): the valid template roles of each host, each with what its slot is, from pages(host, html) and `templates`."""
    names = "host page slot around text plain linked main junk order".split()
    types = [pa.string()] + [pa.int64()] * 7 + [pa.bool_(), pa.int64()]
    schema = pa.schema(list(zip(names, types)))

    def of(row):
        page, template = _page(row["html"]), {t["role"]: t["klass"] for t in row["template"]}
        slots: dict[int, list] = {}
        orders: dict[tuple, list[int]] = {}
        for kind, box, raw, link in _events(row["html"], template):
            if kind == "open":
                if box.slot == box.role:
                    around = box.up.slot if box.up else None
                    slots[box.role] = [around, [], 0, 0, box]
                    orders.setdefault((around, template[box.role]), []).append(box.role)
            elif kind == "text" and not box.junk and not raw.isspace():
                s = slots[box.slot]
                s[1].append(" ".join(raw.split()))
                s[2 + link] += len(raw)
        for role, (around, texts, plain, linked, box) in slots.items():
            text = xxhash.xxh64_intdigest(" ".join(texts).encode("utf-8", "surrogatepass")) >> 1 if texts else None
            order = xxhash.xxh64_intdigest(",".join(map(str, orders[around, template[role]]))) >> 1
            yield row["host"], page, role, around, text, plain, linked, box.main, box.junk, order

    t = text_batches(pages.join(found, "host")).mapInArrow(
        lambda b: _rows(b, schema, of),
        "host string, page long, slot long, around long, text long, plain long, linked long, main long, junk boolean, order long").distinct()
    t = t.groupBy("host", "slot", "around", "main", "junk").agg(
        F.min("text").alias("lo"), F.max("text").alias("hi"), F.count("text").alias("texts"), F.sum("plain").alias("plain"), F.sum("linked").alias("linked"),
        (F.min("order") == F.max("order")).alias("valid"))
    # the text of what is not in one order belongs to the element around it
    t = t.withColumn("slot", F.when(F.col("valid"), F.col("slot")).otherwise(F.col("around")))
    t = t.groupBy("host", "slot").agg(
        F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("texts").alias("texts"), F.sum("plain").alias("plain"), F.sum("linked").alias("linked"),
        F.max(F.when(F.col("valid"), F.col("main"))).alias("main"), F.max(F.col("junk") & F.col("valid")).alias("junk"), F.max("valid").alias("valid"))
    differs = F.coalesce((F.col("lo") != F.col("hi")) | (F.col("texts") < min_pages), F.lit(False))
    t = t.where("valid").withColumn("differs", differs & ~F.col("junk"))
    # an article that differs makes those that are alike on all pages template; without one they are kept
    t = t.withColumn("own", F.max("differs").over(Window.partitionBy("host", "main"))).withColumn(
        "any", F.max(F.col("differs") & F.col("main").isNotNull()).over(Window.partitionBy("host")))
    kind = F.when(F.col("junk"), OTHER).when(F.col("main").isNotNull(), F.when(F.col("own") | ~F.col("any"), MAIN).otherwise(SAME)).when(
        F.col("differs") & (F.col("plain") > F.col("linked")), CONTENT).otherwise(OTHER)
    return t.groupBy("host").agg(F.collect_list(F.struct(F.col("slot").alias("role"), kind.alias("kind"))).alias("slots"))


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def main_text(pages: DataFrame, id: str = "page_id", url: str = "url", html: str = "html", min_pages: int = MIN_PAGES) -> DataFrame:
    """(id, url, text, n_chars) for every row of pages.

    NULL and empty html give an empty text. Pages without a host (NULL or odd urls) form a group of their own.
    Repeated rows come out each; an empty table gives no rows; other columns are not read.
    """
    own = pages.select(F.col(id).alias("id"), F.col(url).alias("url"), host_of(F.col(url)).alias("host"), F.coalesce(F.col(html), F.lit("")).alias("html"))
    read = own.select("host", "html")
    found = cut_lineage(templates(token_classes(read), min_pages))
    slots = cut_lineage(content_slots(read, found, min_pages))
    schema = own.select("id", "url").schema.add("text", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            kinds = ({s["role"]: s["kind"] for s in of or ()} for of in b.column("slots").to_pylist())
            texts = [extract(h, k) for h, k in zip(b.column("html").to_pylist(), kinds)]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("url"), pa.array(texts, pa.string())], names=["id", "url", "text"])

    out = text_batches(own.join(slots, "host", "left")).select("id", "url", "html", "slots").mapInArrow(run, schema)
    return out.select(F.col("id").alias(id), F.col("url").alias(url), "text", F.length("text").cast("long").alias("n_chars"))
