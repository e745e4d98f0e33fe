"""n-gram scan of texts against plain sets of n-grams."""

import random

import numpy as np

from placeloom.operators import evidence as EV, grams


def plain(text, n):
    return {text[i:i + n] for i in range(len(text) - n + 1)}


def test_codes_tell_grams_apart():
    r = random.Random(5)
    text = "".join(r.choice("ab湖图书馆\U0001F600é") for _ in range(3000))
    codes, doubled = grams.gram_codes(text, 4, 2)
    assert len(doubled) == len(text) - 7 and len(set(doubled.tolist())) == len(plain(text, 8))
    assert len(codes) == len(text) - 3
    by_code = {}
    for i, c in enumerate(codes.tolist()):
        assert by_code.setdefault(c, text[i:i + 4]) == text[i:i + 4]
    assert len(by_code) == len(plain(text, 4))
    assert grams.gram_codes("abc", 4, 3) == [] == grams.gram_codes("", 4)
    assert [len(c) for c in grams.gram_codes("a" * 16, 4, 9)] == [13, 9, 1]


def test_pieces_lose_no_gram(monkeypatch):
    text = "".join(random.Random(6).choice("abcdefgh") for _ in range(5000))
    whole = grams._distinct_codes(text, 4, 3)
    monkeypatch.setattr(grams, "PIECE", 64)
    assert np.array_equal(grams._distinct_codes(text, 4, 3), whole) and len(whole) == sum(len(plain(text, n)) for n in (4, 8, 16))


def test_scan_keeps_what_the_table_holds(spark, monkeypatch):
    monkeypatch.setattr(grams, "FLUSH", 3)
    r = random.Random(7)
    texts = [(i, "".join(r.choice("abcd") for _ in range(r.randrange(0, 40)))) for i in range(60)] + [(60, None), (61, ""), (62, "xyzxyzxyz" * 50)]
    rows = spark.createDataFrame(texts, "page_id int, body string")
    every = {(x.page_id, x.gram) for x in grams.grams_in(rows, "page_id", "body", 4).collect()}
    assert len(every) == sum(len(plain(t or "", 4)) for _, t in texts)
    asked = grams.grams_in(spark.createDataFrame([("abca",), ("ddddd",), ("qqqq",)], "a string").selectExpr("a", "a AS b"), "a", "b", 4, longest=True)
    known = {x.gram for x in asked.collect()}
    hits = grams.grams_in(rows, "page_id", "body", 4, 1, grams.bit_table(asked)).collect()
    assert {(x.page_id, x.gram) for x in hits} >= {(p, g) for p, g in every if g in known}
    assert {x.page_id for x in hits} <= set(range(60))  # a text without a searched gram leaves no row


def test_mentions_in_odd_texts(spark):
    long = "x" * 300_000 + "图书馆东门" + "y" * 300_000
    pages = [(1, long), (2, None), (3, ""), (4, "图书馆"), (5, "a图书馆东门"), (5, "a图书馆东门")]
    aliases = [("p", "图书馆东门"), ("q", "图书馆东门"), ("r", "图书馆"), ("s", None), ("t", "zzzz")]
    got = EV.mentions(spark.createDataFrame(pages, "page_id int, key string"), spark.createDataFrame(aliases, "place_id string, alias string")).collect()
    assert sorted((x.page_id, x.place_id) for x in got) == [(1, "p"), (1, "q"), (5, "p"), (5, "q")]
    none = EV.mentions(spark.createDataFrame([], "page_id int, key string"), spark.createDataFrame(aliases, "place_id string, alias string"))
    assert none.count() == 0
