import numpy as np
import pytest

from placeloom.llm import lattice


def brute(rows, t=0.9):
    """n_links and components of (id, vector) rows, by every pair."""
    ok = [i for i, (_, v) in enumerate(rows) if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    n, root = [0] * len(rows), list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, i in enumerate(ok):
        for j in ok[a + 1:]:
            x, y = np.array(rows[i][1], float), np.array(rows[j][1], float)
            if len(x) == len(y) and x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= t:
                n[i] += 1
                n[j] += 1
                root[find(j)] = find(i)
    ids = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            ids[find(i)] = min(k, ids.get(find(i), k))
    return sorted(((k, n[i], ids.get(find(i))) for i, (k, _) in enumerate(rows)), key=str)


def planted(rng, n, dim=64, spread=0.35):
    out = []
    for i in range(n):
        base = rng.normal(size=dim)
        out += [(base + spread * rng.uniform(0, 1) * rng.normal(size=dim)).astype(np.float32) for _ in range(rng.integers(1, 6))]
    return [[float(x) for x in v] for v in out]


@pytest.mark.parametrize("chunk", [2048, 8])
def test_against_brute_force(spark, chunk):
    rng = np.random.default_rng(4)
    v = planted(rng, 60)
    v += [v[0]] * 5 + [v[3]] * 2 + [[2 * x for x in v[1]], [0.0] * 64, None, [], [1.0] * 63 + [None], [float("nan")] + [1.0] * 63, [float("inf")] * 64, [1.0, 2.0], [1.0, 2.1], [1e-30] * 64, [1e30] * 64]
    dense = rng.normal(size=64)
    v += [[float(x) for x in np.float32(dense + 0.05 * rng.normal(size=64))] for _ in range(40)]
    rows = [(i * 7 % 1009, x) for i, x in enumerate(v)] + [(None, v[0])]
    df = spark.createDataFrame([(i, x, 1) for i, x in rows], "vec_id long, embedding array<float>, n int")
    got = lattice.near_duplicates(df, chunk=chunk).collect()
    want = brute(rows)
    assert len(got) == len(rows) and all(r.kept == (r.vec_id == r.component_id) for r in got)
    total = sum(n for _, n, _ in want)
    assert 0.98 * total <= sum(r.n_links for r in got) <= total
    missed = set(want) - {(r.vec_id, r.n_links, r.component_id) for r in got}
    assert len(missed) <= 0.03 * len(want)
    assert lattice.near_duplicates(df.limit(0)).count() == 0


def test_recall_at_the_threshold():
    rng = np.random.default_rng(9)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    x = unit(rng.normal(size=(4000, 64)))
    z = rng.normal(size=x.shape)
    z = unit(z - (z * x).sum(axis=1, keepdims=True) * x)
    for cosine, least in ((0.9, 0.97), (0.95, 0.995)):
        a, b = (lattice.cells(u, lattice.TABLES, lattice.PROBES, lattice.BLOCKS, lattice.SCALE, lattice.SEED) for u in (x, cosine * x + np.sqrt(1 - cosine**2) * z))
        assert (a[:, :, None] == b[:, None, :]).any(axis=(1, 2)).mean() >= least


def test_decoding_finds_the_nearest_point():
    rng = np.random.default_rng(1)
    y = rng.uniform(-2, 2, size=(300, 8))
    c = lattice.decode(y)
    own = ((y - c) ** 2).sum(axis=1)
    for step in np.concatenate((lattice.STEPS, 2 * np.eye(8), -2 * np.eye(8))):
        assert (own <= ((y - c - step) ** 2).sum(axis=1) + 1e-9).all()
    assert own.max() <= 1 + 1e-9 and len(lattice.STEPS) == 240
