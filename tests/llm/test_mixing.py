import hashlib
from fractions import Fraction

from pyspark.sql import functions as F

from placeloom.llm import mixing


def fill(budget, children):
    """children: {name: (capacity, weight)}; repeated sharing until nobody overflows."""
    got, left = {}, {k: v for k, v in children.items() if v[1] > 0}
    while left:
        total = sum(w for _, w in left.values())
        full = [k for k, (c, w) in left.items() if Fraction(budget * w, total) >= c]
        if not full:
            return got | {k: budget * w // total for k, (c, w) in left.items()}
        for k in full:
            got[k] = left.pop(k)[0]
        budget -= sum(got[k] for k in full)
    return got


def test_budgets_flow_to_siblings_first(spark):
    leaves = {("a", "x", "1"): 100, ("a", "x", "2"): 5, ("a", "y", "3"): 40, ("b", "x", "4"): 300, ("b", "z", "5"): 7, ("c", "z", "6"): 0, ("d", "z", "7"): 90}
    w = {("a",): 6, ("b",): 3, ("d",): 0, ("a", "x"): 3, ("a", "x", "2"): 9}
    df = spark.createDataFrame([(*k, n) for k, n in leaves.items()], "l1 string, l2 string, l3 string, tokens long")
    weights = spark.createDataFrame([(*(k + (None,) * (3 - len(k))), n) for k, n in w.items()], "l1 string, l2 string, l3 string, weight long")
    for fraction, epochs in ((0.3, 1), (0.6, 1), (0.9, 2), (0.05, 3)):
        got = {(r.l1, r.l2, r.l3): r.budget for r in mixing.leaf_budgets(df, weights, ["l1", "l2", "l3"], fraction, epochs).collect()}
        cap = {k[:d]: sum(n * epochs for q, n in leaves.items() if q[:d] == k[:d]) for k in leaves for d in (1, 2, 3)}
        level = {(): int(sum(leaves.values()) * fraction)}
        for d in (1, 2, 3):
            level = {k: v for p, b in level.items() for k, v in fill(b, {k: (c, w.get(k, 1)) for k, c in cap.items() if len(k) == d and k[:-1] == p}).items()}
        assert got == level


def test_prefix_of_seeded_epochs(spark):
    rows = [(i, "s" + str(i % 2), "w " * (i % 7)) for i in range(120)] + [(3, "s1", "again"), (None, "s1", "no id"), (500, None, "no source"), (501, "s0", None)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("Level", F.lit(1))
    weights = spark.createDataFrame([("s0", 5)], "level string, weight long")
    out = mixing.mix(df, weights, {"level": F.col("source")}, fraction=0.9, epochs=3, seed=4)
    got = sorted((str(r.row.doc_id), r.row.text or "", r.epoch) for r in out.collect())
    own = {}
    for i, s, t in rows:
        own.setdefault(s or "", []).append((i, t or "", len((t or "").split())))
    total = {s: sum(n for *_, n in v) for s, v in own.items()}
    budget = fill(int(sum(total.values()) * 0.9), {s: (n * 3, 5 if s == "s0" else 1) for s, n in total.items()})
    want = []
    for s, docs in own.items():
        full, part = divmod(budget[s], total[s])
        h = lambda i: hashlib.md5(f"4:{full}:{'' if i is None else i}".encode()).hexdigest()
        for i, t, _ in docs:
            start = sum(n for j, _, n in docs if h(j) < h(i))
            want += [(str(i), t, e) for e in range(full + (start < part))]
    assert got == sorted(want) and max(e for *_, e in got) >= 1
    assert mixing.mix(df.limit(0), weights, {"level": F.col("source")}).count() == 0
