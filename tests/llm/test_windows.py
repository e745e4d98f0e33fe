import random
import re

import numpy as np
import pytest

from placeloom.llm import windows

W = windows.WINDOW


def plain(rows):
    """Result rows by a dictionary of all windows."""
    split = [(i, re.findall("[^\x20\x09-\x0d]+", t or "")) for i, t in rows]
    first = {}
    for i, w in split:
        for k in range(len(w) - W + 1) if i is not None else ():
            seen = tuple(w[k:k + W])
            first[seen] = min(i, first.get(seen, i))
    out = []
    for i, w in split:
        gone = set()
        for k in range(len(w) - W + 1) if i is not None else ():
            if first[tuple(w[k:k + W])] < i:
                gone.update(range(k, k + W))
        out.append((i, len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    return sorted(out, key=str)


def made(rng, n):
    words = [f"w{k}é"[:rng.randint(2, 5)] for k in range(300)]
    pieces = [[rng.choice(words) for _ in range(rng.randint(10, 40))] for _ in range(12)]
    out = []
    for _ in range(n):
        w = [rng.choice(words) for _ in range(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 3)):
            k = rng.randint(0, len(w))
            w[k:k] = rng.choice(pieces)[rng.randint(0, 9):]
        out.append("".join(x + rng.choice([" ", "\n", "\t ", "  "]) for x in w))
    return out


@pytest.mark.parametrize("size, slice", [(windows.BLOCK, windows.SLICE), (500, 40)])
def test_against_all_windows(spark, size, slice):
    rng = random.Random(4)
    texts = made(rng, 150)
    rows = [(i * 37 % 1009, t) for i, t in enumerate(texts)]
    rows += [(2000, texts[3]), (2001, texts[3]), (2001, texts[3]), (1500, texts[9] + " tail"), (None, texts[5]), (None, texts[5]), (-4, texts[8])]
    rows += [(3000, None), (3001, ""), (3002, " \n\t"), (3003, "no break\u0085here " * 13), (3004, "no break\u0085here " * 14), (3005, "same " * 40), (3006, "same " * 12), (3007, "same " * 13)]
    rows += [(4000, " ".join(texts) * 3), (4001, "x" * 5000 + " " + texts[0])]
    df = spark.createDataFrame([(i, t, "b", i, 0) for i, t in rows], "doc_id long, text string, blob string, slice long, block int").repartition(5)
    got = sorted((tuple(r) for r in windows.dedup(df, size=size, slice=slice).collect()), key=str)
    assert got == plain(rows)
    assert sum(r[2] > 0 for r in got) > 50


def test_nothing(spark):
    assert windows.dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_estimates_are_never_low():
    rng = np.random.default_rng(1)
    keys = rng.integers(0, 1 << windows.KEY, 20_000).astype(np.uint32)
    keys = np.concatenate((keys, keys[:3000]))
    own, n = np.unique(keys, return_counts=True)
    got = windows.estimate(own, n)
    assert (got >= n).all() and (got[n == 1] > 1).mean() < 0.05
    parts = windows.estimate(keys, np.ones(len(keys)))  # the merged parts, each key from where it came
    assert (parts >= n[np.searchsorted(own, keys)]).all()


def test_blocks_lose_nothing():
    rows = [(5, b"a b"), (None, b""), (-(2**62), "é ü".encode() * 1000), (0, b"\xff\xfe")]
    ids, null, texts = windows.unpack(windows.pack(*map(list, zip(*rows))))
    assert [None if z else i for i, z in zip(ids.tolist(), null)] == [i for i, _ in rows] and texts == [t for _, t in rows]
