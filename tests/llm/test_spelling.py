import random
import re
import zlib
from collections import Counter

import pytest

from placeloom.llm import fmindex, spelling


def is_near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain(rows):
    """Result rows by every pair of words."""
    counts = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            k = h % len(run)
            counts[run[:k] + run[k + 1:] if h % 97 == 0 else run] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}
    near = {w: [x for x in words if is_near(w, x)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 2 * n else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {(w, form[w], root(w), n, len(near[w]), words.get(form[w])) for w, n in words.items()}


def made(rng, n):
    """Texts of words with one-edit variants, frequent and rare, with chains of forms."""
    letters = "abcdeé×"
    base = ["".join(rng.choice(letters) for _ in range(rng.randint(4, 9))) for _ in range(40)]
    out = list(base)
    for w in base * 2:
        k = rng.randrange(len(w))
        out.append(rng.choice([w[:k] + w[k + 1:], w[:k] + rng.choice(letters) + w[k:], w[:k] + rng.choice(letters) + w[k + 1:]]))
    weights = [rng.choice([1, 3, 10, 40]) for _ in out]
    return [" ".join(w.upper() if rng.random() < 0.1 and w.isascii() else w for w in rng.choices(out, weights, k=60)) for _ in range(n)]


@pytest.mark.parametrize("slot", [32_768, 5])
def test_against_every_pair(spark, slot):
    rng = random.Random(2)
    texts = made(rng, 60)
    rows = [(i, t) for i, t in enumerate(texts)] + [(7, texts[7])] * 2 + [(None, texts[1]), (90, None), (91, ""), (92, "12 ... 中文"), (93, texts[2].replace(" ", ";"))]
    long = "x" * 3000
    rows += [(94, f"{long} {long}y {long} {long} {long}y {long}y {long}z"), (95, long * 2)]
    df = spark.createDataFrame([(i, t, "w", 1) for i, t in rows], "doc_id long, text string, word string, n int").repartition(3)
    got = spelling.variants(df, slot=slot).collect()
    want = plain(rows)
    assert len(got) == len(want) > 60 and {tuple(r) for r in got} == want
    assert sum(r[1] is not None for r in want) > 10 and any(r[1] not in (None, r[2]) for r in want) and any(len(r[0]) > 2000 for r in want)


def test_one_common_half(spark):
    rng = random.Random(5)
    words = {"aaaaa" + "".join(rng.choice("abcd") for _ in range(5)) for _ in range(400)}
    df = spark.createDataFrame([(w, 3 + i) for i, w in enumerate(sorted(words))], "word string, n long")
    got = {r.word: (r.n_near, r.best_n, r.best) for r in spelling.near_words(df, slot=20).collect()}
    n = {r.word: r.n for r in df.collect()}
    for w in words:
        own = [x for x in words if is_near(w, x)]
        best = min(own, key=lambda x: (-n[x], x), default=None)
        assert got.get(w) == ((len(own), n[best], best) if own else None)


def test_nothing(spark):
    assert spelling.variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_searches_find_each_pair_once():
    rng = random.Random(1)
    for trial in range(60):
        letters = "abé"[:trial % 3 + 1]
        words = sorted({"".join(rng.choice(letters) for _ in range(rng.randint(1, 7))) for _ in range(rng.randint(1, 60))})
        asked = words + ["".join(rng.choice("abéx") for _ in range(rng.randint(2, 7))) for _ in range(10)]
        index, got = fmindex.Index(words), []
        for first in (True, False):
            i, j = fmindex.near(index, asked, first)
            got += zip(i.tolist(), j.tolist())
        assert sorted(got) == [(i, j) for i, a in enumerate(asked) for j, b in enumerate(words) if is_near(a, b)]
