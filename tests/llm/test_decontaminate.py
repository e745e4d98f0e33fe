import random
import re

import numpy as np

from placeloom.llm import decontaminate as d


def plain(docs, items, words=5, t=0.8):
    def toks(x):
        return re.findall("[^\x20\x09-\x0d]+", (x or "").lower())

    def sh(w, k):
        return {" ".join(w[i:i + k]) for i in range(len(w) - k + 1)}

    texts, tests = {}, {}
    for i, x in docs:
        texts.setdefault(i, []).append(toks(x))
    for i, x in items:
        w = toks(x)
        if w:
            tests.setdefault(i, (min(words, len(w)), set()))[1].update(sh(w, min(words, len(w))))
    out = set()
    for i, ws in texts.items():
        for j, (k, q) in tests.items():
            shared = len(q & set().union(*(sh(w, k) for w in ws)))
            if shared and shared >= t * len(q) - 1e-9:
                out.add((i, j, shared, len(q)))
    return out


def got(df):
    return {(r.doc_id, r.item_id, r.shared, r.n) for r in df.collect()}


def test_against_brute_force(spark):
    rng = random.Random(5)
    vocab = ["the", "of", "Éa", "été", "x", "y,", "z", "and", "ÑA", "one", "two"] + [f"w{i}" for i in range(60)]
    draw = lambda n: [rng.choice(vocab) for _ in range(n)]
    items = [(i, draw(rng.choice([1, 2, 4, 5, 6, 12, 25, 40, 70]))) for i in range(40)]
    docs = []
    for i in range(150):
        w = draw(rng.choice([0, 3, 40, 400]))
        for _, q in rng.sample(items, 2):
            q = list(q)
            for _ in range(rng.randint(0, 2)):
                q[rng.randrange(len(q))] = "changed"
            at = rng.randint(0, len(w))
            w[at:at] = q
        docs.append((i, rng.choice([" ", "\n", " \t "]).join(w)))
    docs += [(1000, None), (1001, ""), (1001, " ".join(items[5][1])), (1002, " ".join(items[20][1]).upper() + " tail" * 30000), (3, docs[3][1])]
    items = [(i, "  ".join(w)) for i, w in items] + [(90, None), (91, ""), (92, items[5][1][0])]
    a = spark.createDataFrame([(i, t, "q") for i, t in docs], "doc_id long, text string, shingle string")
    b = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, n int")
    want = plain(docs, items)
    assert len(want) > 100
    assert got(d.contained_items(a, b)) == want
    assert got(d.contained_items(a, b, bits=64)) == want  # a full bit table only lets more pass
    assert got(d.contained_items(a.limit(0), b)) == set() == got(d.contained_items(a, b.limit(0)))
    kept = d.drop_contaminated(a, b)
    bad = {i for i, *_ in want}
    assert kept.columns == a.columns and sorted(r.doc_id for r in kept.collect()) == sorted(i for i, _ in docs if i not in bad)


def test_null_ids(spark):
    a = spark.createDataFrame([(None, "a b c d e f g"), (1, "nothing")], "doc_id long, text string")
    b = spark.createDataFrame([(None, "b c d e f")], "item_id long, text string")
    assert got(d.contained_items(a, b)) == {(None, None, 1, 1)}


def test_words_across_segments(monkeypatch):
    texts = ["ab cd  ef", "", " \n", "g" * 50 + " h", "i"]
    raw = "".join(texts).encode()
    off = np.cumsum([0] + [len(t) for t in texts])
    whole = d.words_of(np.frombuffer(raw, np.uint8), off)
    monkeypatch.setattr(d, "SEGMENT", 4)
    parts = d.words_of(np.frombuffer(raw, np.uint8), off)
    assert [raw[a:b] for a, b in zip(*whole[:2])] == [b"ab", b"cd", b"ef", b"g" * 50, b"h", b"i"]
    assert all((x == y).all() for x, y in zip(whole, parts)) and len(set(whole[2].tolist())) == 6
