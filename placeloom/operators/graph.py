"""Iterative graph operators: connected components and keep-first under conflicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from placeloom.operators.scale import skew_join
from placeloom.session import cut_lineage, drop_step


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component) for every id on an edge; the component is its smallest member id.

    Each round every node moves to the smallest neighbour, chains are shortened by pointer jumping, and the
    edge set is contracted to the moved nodes; stops when no edge is left. Minima are partial aggregates, so a
    node with very many edges costs one small row per task.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    e = cut_lineage(e.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct())
    ids = e.select(F.explode(F.array("u", "v")).alias("id")).distinct()
    label = cut_lineage(ids.select("id", F.col("id").alias("component")))
    while not e.isEmpty():
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        parent = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("p"))
        parent = last = cut_lineage(parent)
        while True:  # pointer jumping until every node points at a root
            up = parent.select(F.col("node").alias("p"), F.col("p").alias("pp"))
            jumped = skew_join(parent, up, ["p"]).select("node", F.col("pp").alias("p"), (F.col("pp") != F.col("p")).alias("moved"))
            jumped = cut_lineage(jumped)
            done = jumped.where("moved").isEmpty()
            drop_step(last)
            parent, last = jumped.select("node", "p"), jumped
            if done:
                break
        step = parent.select(F.col("node").alias("component"), "p")
        older, label = label, cut_lineage(skew_join(label, step, ["component"], "left").select("id", F.coalesce("p", "component").alias("component")))
        drop_step(older)
        pu = parent.select(F.col("node").alias("u"), F.col("p").alias("pu"))
        pv = parent.select(F.col("node").alias("v"), F.col("p").alias("pv"))
        moved = skew_join(skew_join(e, pu, ["u"]), pv, ["v"]).where("pu <> pv")
        older, e = e, cut_lineage(moved.select(F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v")).distinct())
        drop_step(older)
        drop_step(last)
    return label


def _kept_on_paths(state: DataFrame) -> DataFrame:
    """(id): nodes that are kept for certain. state(id, up): `up` is the node's only open earlier neighbour, NULL if it has none.

    Without one a node is kept; with one it is kept if that one is dropped, so kept and dropped alternate along a path
    and the parity of a node's distance to the path's start decides. Distances come from pointer doubling: a path of n
    nodes takes log2(n) steps. A path that starts at a node with several open neighbours stays open.
    """
    free = state.where("up is null").select("id")
    ptr = state.where("up is not null").select("id", "up", F.lit(True).alias("odd"))
    if ptr.isEmpty():
        return free
    last = None
    while True:
        nxt = ptr.select(F.col("id").alias("up"), F.col("up").alias("up2"), F.col("odd").alias("odd2"))
        far = skew_join(ptr, nxt, ["up"], "left").select(
            "id", F.coalesce("up2", "up").alias("up"), (F.col("odd") != F.coalesce("odd2", F.lit(False))).alias("odd"), F.col("up2").isNotNull().alias("moved"))
        far = cut_lineage(far)
        drop_step(last)
        ptr, last = far.select("id", "up", "odd"), far
        if far.where("moved").isEmpty():
            break
    even = skew_join(ptr.where("not odd"), free.select(F.col("id").alias("up")), ["up"], "left_semi")
    return free.unionByName(even.select("id"))


def keep_first(nodes: DataFrame, conflicts: DataFrame) -> DataFrame:
    """Scan in order and keep a node unless an earlier kept node conflicts with it: (id, kept, blocked_by).

    nodes(id, ord, clique): members of one clique (equal key; NULL for none) conflict with each other, which is
    settled from the clique's first open member, never from its pairs. conflicts(earlier, later): further edges,
    directed by (ord, id). Each round looks at the open clique heads with at most one open earlier neighbour, which
    form paths, settles the paths in whole, and drops what the kept nodes block; only nodes with several open
    neighbours wait for a further round. blocked_by is the smallest id of the kept earlier nodes in conflict.
    """
    own = F.concat(F.lit("own:"), F.col("id").cast("string"))
    tagged = F.concat(F.lit("key:"), F.col("clique").cast("string"))
    every = todo = cut_lineage(nodes.select("id", "ord", F.coalesce(tagged, own).alias("clique")))
    links = edges = cut_lineage(conflicts.select("earlier", "later").where("earlier <> later").distinct())
    decided = None
    while not todo.isEmpty():
        heads = todo.groupBy("clique").agg(F.min(F.struct("ord", "id")).alias("f")).select("clique", F.col("f.id").alias("id"))
        waits = edges.groupBy(F.col("later").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.min("earlier").alias("up"))
        state = cut_lineage(heads.join(waits, "id", "left").where("n is null or n = 1").select("id", "up", "clique"))
        kept = cut_lineage(_kept_on_paths(state))
        by_edge = skew_join(edges, kept.select(F.col("id").alias("earlier")), ["earlier"]).select(F.col("later").alias("id"))
        taken = state.join(kept, "id", "left_semi").select("clique", F.col("id").alias("first"))
        by_key = skew_join(todo.select("id", "clique"), taken, ["clique"]).where("id <> first").select("id")
        lost = by_edge.unionByName(by_key).distinct()
        step = cut_lineage(kept.select("id", F.lit(True).alias("kept")).unionByName(lost.select("id", F.lit(False).alias("kept"))))
        decided = step if decided is None else decided.unionByName(step)
        settled = step.select("id")
        older, todo = (todo, edges), cut_lineage(todo.join(settled, "id", "left_anti"))
        open_ends = skew_join(edges, settled.select(F.col("id").alias("earlier")), ["earlier"], "left_anti")
        edges = cut_lineage(skew_join(open_ends, settled.select(F.col("id").alias("later")), ["later"], "left_anti"))
        for table in (*(t for t in older if t is not every and t is not links), state, kept):
            drop_step(table)
    if decided is None:
        return nodes.select("id", F.lit(True).alias("kept"), F.col("id").alias("blocked_by")).limit(0)
    kept = decided.where("kept").select("id")
    by_edge = skew_join(links, kept.select(F.col("id").alias("earlier")), ["earlier"]).select(
        F.col("later").alias("id"), F.col("earlier").alias("by"))
    shared = every.where(F.col("clique").startswith("key:"))
    first = shared.join(kept, "id", "left_semi").select("clique", F.struct("ord", "id").alias("f"))
    by_key = skew_join(shared, first, ["clique"]).where(F.col("f") < F.struct("ord", "id")).select("id", F.col("f.id").alias("by"))
    by = by_edge.unionByName(by_key).groupBy("id").agg(F.min("by").alias("blocked_by"))
    return decided.join(by, "id", "left").select("id", "kept", "blocked_by")
