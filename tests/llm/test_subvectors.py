import hashlib
import math

import numpy as np
import pytest

from placeloom.llm import subvectors


def brute(rows, k, rounds, seed=2):
    """Sorted result rows, by Python integers and every distance."""
    ok = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows
          if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(ok, key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    cents = [v for _, v in order[:k]]

    def near(v):
        d = [sum((a - b) ** 2 for a, b in zip(v, c)) for c in cents]
        return d.index(min(d)), min(d)

    for _ in range(rounds):
        got = [near(v)[0] for _, v in ok]
        for c in range(len(cents)):
            own = [v for (_, v), g in zip(ok, got) if g == c]
            if own:
                cents[c] = [sum(x) // len(own) for x in zip(*own)]
    last = [(i, *near(v)) for i, v in ok]
    inertia = {c: sum(d for _, g, d in last if g == c) for c in range(len(cents))}
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in cents]
    return sorted(((i, c, d, inertia[c], sum(inertia.values()), sha[c]) for i, c, d in last), key=str)


@pytest.mark.parametrize("chunk, block", [(16_384, 2), (7, 5), (50, 1), (50, 64)])
def test_against_brute_force(spark, chunk, block):
    rng = np.random.default_rng(3)
    v = [[float(x) for x in np.float32(rng.normal(size=64) / 8)] for _ in range(90)]
    v += [v[0]] * 12 + [[0.0] * 64] * 2 + [[-0.001] * 64, None, [], [1.0] * 63, [1.0] * 65, [None] + [1.0] * 63, [float("nan")] * 64, [float("-inf")] + [0.0] * 63]
    rows = [(i * 31 % 997, x) for i, x in enumerate(v)] + [(5, v[1]), (5, v[2]), (None, v[3])]
    df = spark.createDataFrame([(i, x, i, "a") for i, x in rows], "vec_id long, embedding array<float>, cluster long, v string").repartition(3)
    got = subvectors.clusters(df, k=9, rounds=3, chunk=chunk, block=block).collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows, 9, 3)


def test_fewer_vectors_than_centroids_and_none(spark):
    df = spark.createDataFrame([(i, [i / 7] * 64) for i in range(3)], "vec_id long, embedding array<double>")
    assert sorted((tuple(r) for r in subvectors.clusters(df).collect()), key=str) == brute([tuple(r) for r in df.collect()], 40, 5)
    assert subvectors.clusters(df.limit(0)).count() == 0


def test_dictionaries_lose_nothing():
    v = np.random.default_rng(1).integers(-3, 3, size=(500, 64))
    for block in (1, 2, 3, 64):
        dictionaries, codes = subvectors.encode(v, block)
        assert (np.concatenate([d[c] for d, c in zip(dictionaries, codes)], axis=1) == v).all()
        assert all(len(np.unique(d, axis=0)) == len(d) <= 500 for d in dictionaries)
