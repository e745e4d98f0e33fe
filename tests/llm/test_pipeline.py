"""Each stage of the pipeline against a plain version on that stage's own input."""

import hashlib
import os

import pytest

import corpus_pipeline as pipeline
from placeloom.llm import quality, queries
from placeloom.llm.common import scratch_path
from test_decontaminate import plain as plain_contained
from test_mixing import fill
from test_nearcopies import plain_groups
from test_sharding import plain as plain_shards

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.01")


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in pipeline.STAGES:
        path = scratch_path(spark, name)
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return [(d.columns, {r.doc_id: r for r in d.collect()}, d.count()) for d in out]


def test_columns_and_rows(spark, steps):
    first = steps[0][0]
    assert all(c == first for c, _, _ in steps[:-1]) and steps[-1][0] == [*first, "shard", "shard_bytes", "over_limit"]
    for (_, before, _), (_, after, n) in zip(steps, steps[1:]):
        assert n == len(after) and 0 < len(after) <= len(before)
        assert all(before[i][:5] == r[:5] for i, r in after.items())


def test_quality(spark, steps):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    m = queries.quality_model(spark, docs, SF)
    want = {i for i, r in steps[0][1].items() if m.slope * quality.evidence(m, r.text) + m.intercept >= 0}
    assert set(steps[1][1]) == want
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = [i in want for i in steps[0][1] if labels.get(i) == 1]
    assert sum(kept) / len(kept) > 0.97


def test_near_copies(steps):
    before = {i: r.text for i, r in steps[1][1].items()}
    assert set(steps[2][1]) == set(plain_groups(before).values())


def test_benchmark(spark, steps):
    before = steps[2][1]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    bad = {i for i, *_ in plain_contained([(i, r.text) for i, r in before.items()], items)}
    assert bad and set(steps[3][1]) == set(before) - bad


def test_mixture(steps):
    before, leaves = steps[3][1], {}
    for i, r in before.items():
        leaves.setdefault((("web", "books", "forum")[int(r.source[3:]) % 3], r.lang, r.source), []).append((i, len(r.text.split())))
    tokens = {k: sum(n for _, n in v) for k, v in leaves.items()}
    weight = {(d,): w for d, w in queries.DOMAIN_WEIGHTS.items()} | {(d, g): w for d in queries.DOMAIN_WEIGHTS for g, w in queries.LANG_WEIGHTS.items()}
    level = {(): int(sum(tokens.values()) * 0.9)}
    for d in (1, 2, 3):
        cap = {p: sum(n for k, n in tokens.items() if k[:d] == p) for p in {k[:d] for k in leaves}}
        level = {k: v for p, b in level.items() for k, v in fill(b, {k: (c, weight.get(k, 1)) for k, c in cap.items() if k[:-1] == p}).items()}
    want = set()
    for k, docs in leaves.items():
        full, part = divmod(level[k], tokens[k])
        h = lambda i: hashlib.md5(f"1:{full}:{i}".encode()).hexdigest()
        for i, _ in docs:
            if full or sum(n for j, n in docs if h(j) < h(i)) < part:
                want.add(i)
    assert set(steps[4][1]) == want and len(want) < len(before)


def test_shards(steps):
    got = sorted(((r.doc_id, len(r.text.encode()), r.shard, r.shard_bytes, r.over_limit) for r in steps[5][1].values()), key=str)
    assert got == plain_shards([(i, r.text) for i, r in steps[4][1].items()], queries.SHARD_BYTES)


def test_run_on_empty_tables(spark, tmp_path):
    for t in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").limit(0).write.parquet(f"{tmp_path}/{t}.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0


def test_odd_rows(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(50)
    odd = spark.createDataFrame(
        [(None, None, None, None, None), (None, None, None, None, None), (-1, None, "en", "src0", 0), (-2, "", None, "no number", 0), (-2, "", None, "no number", 0), (-3, "long word " * 60_000, "en", None, 1)], docs.schema)
    docs.unionByName(odd).write.parquet(f"{tmp_path}/documents.parquet")
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    ids = [r.doc_id for r in pipeline.run(spark, str(tmp_path)).collect()]
    assert len([i for i in ids if i is not None]) == len({i for i in ids if i is not None})
