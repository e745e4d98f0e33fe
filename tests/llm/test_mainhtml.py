import html
import random
import re
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from placeloom.llm import mainhtml, queries

SF = "/root/testdata/sf0.01"


def article(page):
    """Text of the pages of the test tables: blocks between the article's paragraph and heading tags."""
    inner = re.search("<article>(.*)</article>", page, re.S)[1]
    blocks = (re.sub("<[^>]*>", "", re.sub("<br>", " ", b)) for b in re.split("</?(?:p|h1)>", inner))
    return "\n".join(t for t in (" ".join(html.unescape(b).split()) for b in blocks) if t)


def test_query(spark):
    want = {r.page_id: article(r.html) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = {r.page_id: r for r in queries.op10_main_text(spark, SF).collect()}
    assert {i: r.text for i, r in got.items()} == want
    assert all(r.n_chars == len(r.text) for r in got.values())


PAGE = """<!DOCTYPE html><HTML><head><title>T {i}</title><script>if (a<b) document.write("<p>no {i}</p>")</script></head><body class="page-{i}">
<div id="top-menu"><a href=/>Home {i}</a></div><div class="cookie-notice">We use cookies {i}</div><header><h1>Site</h1></header>
<div class="c{i} body"><h2>Head &amp; line {i}</h2><p>First&nbsp;&#233;  {more}<p>Second <b>bold{i}</b>ly a &lt; b<ul><li>one<li>two {i}</ul><!-- <p>not</p> -->
<aside>Side {i}</aside><form>Name <input name=x><button>Go</button></form></div><div class="x y"><a href="/a{i}">Other {i}</a> <a href="/b">More links of the site here and there</a></div>
<section class="comments"><p>Reader {i} says a very long thing indeed, longer than anything in the page's own text, again and again.</p></section><footer>&copy; {i}</footer></body></HTML>"""


def page(i):
    more = "text " * 20 + f"number {i}"
    want = f"Head & line {i}\nFirst é {more}\nSecond bold{i}ly a < b\none\ntwo {i}"
    return PAGE.format(i=i, more=more), want


@pytest.mark.parametrize("n", [1, 6])
def test_pages_without_article(spark, n):
    rows = [(i, "http://Site.example/x", page(i)[0], 0) for i in range(n)]
    got = {r.page_id: r.text for r in mainhtml.main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text int")).collect()}
    for i in range(n):
        want = page(i)[1]
        assert got[i] == want if n > 1 else got[i].startswith(want)


def role(html, *names):
    """Role of the first box under these tags, from the outermost."""
    for kind, box, _, _ in mainhtml.walk(html):
        if kind == "open":
            path, b = [], box
            while b.up:
                path, b = [b.tag, *path], b.up
            if path == list(names) and not box.junk:
                return box.role


def test_classes_and_slots(spark):
    rows = spark.createDataFrame([("h", page(i)[0]) for i in range(6)], "host string, html string")
    classes = mainhtml.token_classes(rows)
    t = {r.role: r for r in classes.collect()}
    body = role(page(0)[0], "html", "body", "div")
    assert t[body].klass == t[0].klass and t[body].pages == t[body].n == 6
    slots = mainhtml.content_slots(rows, mainhtml.templates(classes)).collect()
    kinds = {s.role: s.kind for r in slots for s in r.slots}
    texts = {mainhtml.extract(page(0)[0], {k: mainhtml.CONTENT if k == c else mainhtml.OTHER for k in kinds}) for c, kind in kinds.items() if kind == mainhtml.CONTENT}
    lines = page(0)[1].split("\n")
    assert texts == {"\n".join(lines[:-2]), "\n".join(lines[-2:])}  # the text of the box and that of the list in it


def test_odd_pages(spark):
    rows = [
        (1, None, None), (1, None, None), (2, "", ""), (3, "nohost", "plain <b>text</b> &amp"), (4, "http://h", "<article><p>a<p>b"), (5, "http://h", "<<<>>> a < b </p></div>"),
        (6, "http://h", "<article>" + "<p>" * 50_000 + "deep</article>"), (7, "http://h", "<div>" * 3000 + "x" + "</div>" * 3000), (8, "http://h", '<article class="a"><p title="x > y">t</p>'),
        (9, "http://h", "<script>never closed <p>a"), (10, "http://h", "<!-- never closed <p>a"), (11, "http://h", "<p 'unclosed quote>a <article>b")]
    got = [(r.page_id, r.text, r.n_chars) for r in mainhtml.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).orderBy("page_id").collect()]
    texts = dict((i, t) for i, t, _ in got)
    assert len(got) == len(rows) and texts[1] == texts[2] == texts[9] == texts[10] == ""
    assert texts[3] == "plain text &" and texts[4] == "a\nb" and texts[6] == "deep" and texts[7] == "x" and texts[8] == "t"
    assert mainhtml.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def texts_of(spark, pages):
    rows = [(i, "http://odd.example/x", h) for i, h in enumerate(pages)]
    got = mainhtml.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    return {r.page_id: r.text for r in got}


def test_odd_pages_of_a_host(spark):
    shell = "<html><body><div class=intro>Site words {i}</div>{x}<div class=after>More words {i}</div></body></html>"
    pages = [shell.format(i=i, x=f"<article><p>Text {i}</article>") for i in range(6)]
    odd = [None, shell.format(i=7, x="<div class=only>Seven</div>"), shell.format(i=8, x="<article>Eight</article><article>Nine</article>")]
    got = texts_of(spark, pages + odd)
    assert [got[i] for i in range(6)] == [f"Text {i}" for i in range(6)]
    assert got[6] == "" and got[7] == "Site words 7\nSeven\nMore words 7" and got[8] == "Eight\nNine"


def test_split_content(spark):
    page = ("<html><body><div class=same>Same on all pages</div><div class=post>Own {i}<div class=post-title>Title {i}</div><div class=post-lead>Lead {i}</div>"
            "<div class=post-body>Body {i} is the longest part of the page</div></div><div class=more><a href=/>Link {i} and more</a></div></body></html>")
    got = texts_of(spark, [page.format(i=i) for i in range(5)])
    assert got == {i: f"Own {i}\nTitle {i}\nLead {i}\nBody {i} is the longest part of the page" for i in range(5)}


def shell(body):
    return f"<html><body>{body}</body></html>"


def test_names_break_ties_only(spark):
    note = "<div class=note>Site note of the day {i}</div>"
    cases = {
        "<div class='post share-ready'><p>Article {i} text</div>" + "<div class=tools><a href=/>Links {i}</a></div>": "Article {i} text",
        note + "<article><p>Text {i}<div class=related-work><p>Work {i}</div><div class=share-bar>Share {i}</div></article>": "Text {i}\nWork {i}",
        "<article><p>Text {i}</article><article class=teaser><p>Other story {i}</article><article class=comment>Reader {i}</article>": "Text {i}",
        "<article><p>Text {i}</article><article class=join><p>Join us</article>": "Text {i}",
        "<div class=box0>Home News Sport</div><div class=box1>Own {i}</div><div class=box2>Buy now</div>": "Own {i}",
        "<form action=/><div class=a>Own {i}<form><input></form></div></form>": "Own {i}",
        "<div class=content-with-sidebar><div class=t>Own {i}</div><div class=sidebar>Side {i}</div></div>": "Own {i}"}
    for body, want in cases.items():
        got = texts_of(spark, [shell(body.replace("{i}", str(i))) for i in range(5)])
        assert got == {i: want.replace("{i}", str(i)) for i in range(5)}, body


TWO = ["<div class=box>Menu words</div><div class=box>Own {i} of the first kind</div><div class=box>Advert</div>",
       "<section>Second menu</section><section><div class=in>Own {i} of the second kind</div></section>"]


def two_templates():
    """Two templates on one host, an optional constant box on some pages of the first, and copies of one page."""
    pages, want = [], []
    for i in range(20):
        kind = i % 2
        extra = "<div class=extra>Only at times</div>" if i % 4 == 0 else ""
        pages.append(shell(extra + TWO[kind].format(i=i)))
        want.append(f"Own {i} of the {('first', 'second')[kind]} kind")
    return pages + [pages[3]] * 30, want + [want[3]] * 30


def test_two_templates_and_copies(spark):
    pages, want = two_templates()
    assert texts_of(spark, pages) == dict(enumerate(want))


def test_broken_classes_change_the_result(spark, monkeypatch):
    pages, want = two_templates()
    whole = mainhtml.token_classes
    monkeypatch.setattr(mainhtml, "token_classes", lambda p: whole(p).withColumn("klass", F.lit(1).cast("long")))
    assert texts_of(spark, pages) != dict(enumerate(want))


def test_parts_in_no_order_are_no_template(spark):
    parts = ["<div class=a>Alike</div>", "<div class=b>Own {i}</div>"]
    got = texts_of(spark, [shell("".join(parts if i % 2 else parts[::-1]).format(i=i)) for i in range(6)])
    assert got == {i: f"Alike\nOwn {i}" if i % 2 else f"Own {i}\nAlike" for i in range(6)}


class Tree(HTMLParser):
    """A well-formed page as nested lists [name, children], text as str; names carry their number among equal ones."""

    def __init__(self, html):
        super().__init__()
        self.top = self.now = ["#", [], None]
        self.feed(html)

    def handle_starttag(self, tag, attrs):
        name = (tag, tuple(v for _, v in attrs))
        box = [(name, sum(isinstance(c, list) and c[0][0] == name for c in self.now[1])), [], self.now]
        self.now[1].append(box)
        self.now = box

    def handle_endtag(self, tag):
        self.now = self.now[2]

    def handle_data(self, data):
        self.now[1].append(data)


def plain_texts(pages):
    """The method on one host, one step after the other, with vectors as sets of pages."""
    trees = {h: Tree(h).top for h in pages}
    boxes = lambda b, path=(): [(path, b)] + [x for c in b[1] if isinstance(c, list) for x in boxes(c, (*path, c[0]))]
    vector = {}
    for h, t in trees.items():
        for path, _ in boxes(t):
            vector.setdefault(path, set()).add(h)
    frequent = {p for p, v in vector.items() if len(v) >= 3 and len(v) >= 0.05 * len(trees)}

    def slot(path, template):
        while path not in template:
            path = path[:-1]
        return path

    orders = {}
    for h, t in trees.items():
        groups = {}
        for path, _ in boxes(t):
            if path in frequent and path:
                groups.setdefault((slot(path[:-1], frequent), frozenset(vector[path])), []).append(path)
        for key, paths in groups.items():
            orders.setdefault(key, set()).add(tuple(paths))
    template = frequent - {p for seqs in orders.values() if len(seqs) > 1 for s in seqs for p in s}

    def blocks(b, path=()):
        for c in b[1]:
            if isinstance(c, str):
                yield slot(path, template), c
            else:
                yield from blocks(c, (*path, c[0]))

    seen = {}
    for h, t in trees.items():
        own = {}
        for s, text in blocks(t):
            own.setdefault(s, []).append(text)
        for s, texts in own.items():
            seen.setdefault(s, []).append(" ".join(texts))
    content = {s for s, texts in seen.items() if len(set(texts)) > 1 or len(texts) < 3}
    out = []
    for h in pages:
        every = list(blocks(trees[h]))
        out.append("\n".join([t for s, t in every if s in content] or [t for _, t in every]))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_against_plain_method(spark, seed):
    rng = random.Random(seed)

    def part(depth, i):
        if depth == 0 or rng.random() < 0.3:
            return rng.choice(["Alike", "Alike too", f"Own {i}", f"Own {rng.random()}"])
        return "".join(f"<{t} class={c}>{part(depth - 1, i)}</{t}>" for t, c in (rng.choice(kinds) for _ in range(rng.randint(1, 3))))

    kinds = [("div", "a"), ("div", "b"), ("section", "c")]
    fixed = [part(2, "{i}") for _ in range(3)]
    pages = []
    for i in range(40):
        pieces = [f.format(i=i) for f in fixed if rng.random() < 0.9] + ([part(3, i)] if rng.random() < 0.4 else [])
        if rng.random() < 0.1:
            rng.shuffle(pieces)
        pages.append(shell("".join(f"<div class=x{'yz'[k % 2]}>{p}</div>" for k, p in enumerate(pieces))))
    pages += pages[:3] * 5
    assert texts_of(spark, pages) == dict(enumerate(plain_texts(pages)))
