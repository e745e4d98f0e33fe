import random
import re

import numpy as np
import pytest
import xxhash

from placeloom.llm import simhash


def plain_fingerprint(text):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall("[^\x20\x09-\x0d]+", t)
    s = [" ".join(w[i:i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(x.encode(), seed=42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def plain_components(fps):
    ids = sorted(fps)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, i in enumerate(ids):
        for j in ids[k + 1:]:
            if bin(fps[i] ^ fps[j]).count("1") <= 3:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_fingerprint():
    for t in [None, "", "  \n", "One", "a b", "A b C", "É x Y\x0bz a a a a a a a", "x " * 70000, "Ab cD " * 9 + "  q"]:
        assert simhash.fingerprint(t) == plain_fingerprint(t)


@pytest.mark.parametrize("chunk", [4096, 8])
def test_links_find_every_component(spark, chunk):
    rng = random.Random(3)
    fps = set()
    for _ in range(12):  # chains and balls around some values, and lone values
        x = rng.getrandbits(64)
        for _ in range(40):
            y = x
            for b in rng.sample(range(64), rng.randint(1, 5)):
                y ^= 1 << b
            fps.add(y)
            x = y if rng.random() < 0.4 else x
    fps |= {rng.getrandbits(64) for _ in range(100)} | {0, 1, 2**64 - 1}
    fps = {i: f for i, f in enumerate(sorted(fps))}
    df = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in fps.values()], "fp long")
    want, name = plain_components(fps), {int(np.uint64(f).view(np.int64)): i for i, f in fps.items()}
    links = {(name[r.a], name[r.b]) for r in simhash.links(df, chunk).collect()}
    root = {i: i for i in fps}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        assert want[a] == want[b]
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    assert {i: find(i) for i in fps} == want


def test_groups_on_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    odd = spark.createDataFrame([(-3, None), (-2, ""), (-2, ""), (-1, " \n"), (None, "only here and nowhere else"), (990000, docs.first().text)], docs.schema)
    rows = docs.unionByName(odd)
    got = simhash.groups(rows).collect()
    texts = [(r.doc_id, r.text) for r in rows.collect()]
    assert len(got) == len(texts)
    want = plain_components({i: plain_fingerprint(t) for i, t in texts if i is not None})
    for r in got:
        assert r.component_id == want.get(r.id)
    assert {r.component_id for r in got if r.id in (-3, -2, -1)} == {-3}
    kept = simhash.keep_one(rows).collect()
    assert sorted(r.doc_id for r in kept if r.doc_id is not None) == sorted({c for i, c in want.items()})
    assert sum(r.doc_id is None for r in kept) == 1
    assert simhash.groups(rows.limit(0)).count() == 0
