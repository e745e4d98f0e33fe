"""Keep-first on paths, cliques and random graphs, and close hashes on one large key, against sequential versions."""

import random

import pytest
from pyspark.sql import functions as F

from placeloom.operators import gallery as G, graph


def scan(n, pairs, clique=()):
    before = {}
    for a, b in pairs:
        before.setdefault(b, []).append(a)
    kept, taken = set(), set()
    for i in range(n):
        c = dict(clique).get(i)
        if not any(a in kept for a in before.get(i, ())) and (c is None or c not in taken):
            kept.add(i)
            taken.add(c)
    return kept


def run(spark, n, pairs, clique=()):
    named = dict(clique)
    nodes = spark.createDataFrame([(i, i, named.get(i)) for i in range(n)], "id long, ord long, clique string")
    out = graph.keep_first(nodes, spark.createDataFrame(pairs, "earlier long, later long")).collect()
    assert len(out) == n == len({r.id for r in out})
    return {r.id: r for r in out}


def test_long_path_takes_few_steps(spark, monkeypatch):
    stored = []
    plain = graph.cut_lineage
    monkeypatch.setattr(graph, "cut_lineage", lambda df: stored.append(1) or plain(df))
    n = 10_000
    out = run(spark, n, [(i, i + 1) for i in range(n - 1)])
    assert {i for i, r in out.items() if r.kept} == set(range(0, n, 2))
    assert all(r.blocked_by == (None if r.kept else i - 1) for i, r in out.items())
    assert len(stored) < 40


@pytest.mark.parametrize("seed", range(3))
def test_random_graphs(spark, seed):
    r = random.Random(seed)
    n = 300
    pairs = {tuple(sorted(r.sample(range(n), 2))) for _ in range((60, 250, 900)[seed])}
    pairs |= {(i, i + 1) for i in range(40, 140)}  # a path among them
    pairs |= {(7, i) for i in range(8, 60)}  # one node before very many
    clique = {i: f"c{r.randrange(20)}" for i in range(n) if r.random() < 0.3} | {i: "hot" for i in range(150, 250)}
    out = run(spark, n, list(pairs), clique)
    kept = scan(n, pairs, clique)
    assert {i for i, x in out.items() if x.kept} == kept
    for i, x in out.items():
        by = [k for k in kept if k < i and ((k, i) in pairs or (i in clique and clique.get(k) == clique[i]))]
        assert x.blocked_by == (None if i in kept else min(by))


def test_no_nodes_no_edges(spark):
    assert run(spark, 0, []) == {}
    assert all(r.kept for r in run(spark, 5, []).values())


@pytest.mark.parametrize("limit", [0, 1, 2, 7, 8, 10])
@pytest.mark.parametrize("small", [0, 10_000])
def test_close_hashes_equal_brute_force(spark, limit, small):
    r = random.Random(limit)
    base = [r.getrandbits(64) for _ in range(8)]
    rows = []
    for i in range(240):
        h = r.choice(base)
        for _ in range(r.randrange(0, 9)):
            h ^= 1 << r.randrange(64)
        rows.append((0 if i % 3 else r.randrange(3), h - (1 << 64) if h >> 63 else h))
    rows += [(0, 0), (0, -1), (1, None), (None, 5), (None, 4), rows[0], rows[0]]
    got = [(x.place_id, x.ha, x.hb) for x in G.close_hashes(spark.createDataFrame(rows, "place_id int, dhash long"), limit, small=small).collect()]
    seen = {x for x in rows if None not in x}
    want = {(p, a, b) for p, a in seen for q, b in seen if p == q and a < b and bin((a ^ b) & (2**64 - 1)).count("1") <= limit}
    assert len(got) == len(set(got)) and set(got) == want


def test_random_hashes_of_one_key_seldom_meet(spark):
    n = 100_000
    rows = spark.range(n, numPartitions=8).select(F.lit(1).alias("place_id"), F.xxhash64("id").alias("dhash"))
    met = []
    plain = G.skew_join
    G.skew_join, keep = (lambda a, b, keys, *how: met.append(plain(a, b, keys, *how)) or met[-1]), plain
    try:
        assert G.close_hashes(rows).count() == 0
    finally:
        G.skew_join = keep
    pairs = n * (n - 1) / 2
    assert met[-1].count() / 2 < 0.01 * pairs
