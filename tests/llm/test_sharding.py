import hashlib

from placeloom.llm import sharding
from placeloom.llm.common import scratch_path


def plain(rows, limit):
    """Split buckets over the limit bit by bit."""
    own = [(int(hashlib.md5(f"0:{i if i is not None else hashlib.md5((t or '').encode()).hexdigest()}".encode()).hexdigest()[:15], 16), len((t or "").encode()), i) for i, t, *_ in rows]
    out, todo = [], [("", own)]
    while todo:
        name, part = todo.pop()
        if not part:
            continue
        total = sum(n for _, n, _ in part)
        if total <= limit or len({a for a, _, _ in part}) == 1:
            out += [(i, n, name, total, total > limit) for _, n, i in part]
            continue
        for bit in "01":
            todo.append((name + bit, [p for p in part if format(p[0], "060b")[len(name)] == bit]))
    return sorted(out, key=str)


def rows():
    out = [(i, "é" * (i % 37), "x") for i in range(700)] + [(5, "y" * 4000, None), (5, "y" * 4000, None), (1000, "z" * 9000, "s")]
    return out + [(None, "a", None), (None, None, None), (None, "b" * 70, None), (1001, None, "q"), (1002, "", "q")]


def test_against_splitting(spark):
    df = spark.createDataFrame(rows(), "doc_id long, text string, shard string")
    for limit in (50, 900, 10**6):
        got = sharding.shard_of(df, limit).select("row.doc_id", "bytes", "shard", "shard_bytes", "over_limit").collect()
        assert sorted((tuple(r) for r in got), key=str) == plain(rows(), limit)
    assert sharding.shard_of(df.limit(0), 9).count() == 0


def test_cells_over_the_limit_are_opened(spark, monkeypatch):
    monkeypatch.setattr(sharding, "SPREAD", -3)
    monkeypatch.setattr(sharding, "STEP", 2)
    df = spark.createDataFrame(rows(), "doc_id long, text string, shard string")
    got = sharding.shard_of(df, 60).select("row.doc_id", "bytes", "shard", "shard_bytes", "over_limit").collect()
    assert sorted((tuple(r) for r in got), key=str) == plain(rows(), 60)


def test_written(spark):
    df = spark.createDataFrame(rows(), "doc_id long, text string, shard string")
    path = scratch_path(spark, "shards")
    sharding.write_shards(df, path, 900)
    back = spark.read.parquet(path)
    assert back.count() == len(rows()) and {"doc_id", "text", "shard", "shard_"} == set(back.columns)
