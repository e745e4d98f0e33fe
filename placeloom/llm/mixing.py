"""Mixing sources to target weights: budgets run down a tree of domains, languages and sources.

A node's budget is shared among its children by weight. No child can get more than its subtree holds (tokens times
the allowed epochs); what such a child cannot use is shared anew among its siblings, and only when all of them are
full is anything left for the ancestors' other children. That is one water level per node: sorted by
capacity / weight, a child is full exactly if capacity * W <= (budget - C) * weight, where W is the weight of it and of
all later children and C the capacity of the earlier ones. So each tree level is one window over nodes, and
documents are never gathered.

A leaf's budget buys whole epochs and then a prefix of one more. Each epoch has its own order, by the MD5 of seed,
epoch and id. The end of the prefix is found in two steps, from token sums of 4096 hash slices and then inside the one
slice where the budget ends, so a leaf with a third of all rows is never sorted in one task. Selecting is then a
filter of each document against its leaf's cut.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from placeloom.llm.common import cut_lineage, text_of

WORD = r"[^\x20\x09-\x0D]+"


def word_tokens(text: str = "text") -> Column:
    """Words at ASCII white space, the default measure of a text."""
    return F.regexp_count(text_of(text), F.lit(WORD)).cast("long")


def _whole(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(38,0)")


def _share(children: DataFrame, parent: list[str], key: str) -> DataFrame:
    """children(parent..., key, capacity, weight, budget of the parent) with their own budgets; one water level per parent."""
    order = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))  # the root has a few domains
    by = order.orderBy(F.col("capacity") / F.col("weight"), key)
    before = F.coalesce(F.sum("capacity").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    later = F.sum("weight").over(by.rowsBetween(0, Window.unboundedFollowing))
    c = children.where("weight > 0").withColumn("before", before).withColumn("later", later)
    c = c.withColumn("full", _whole("capacity") * _whole("later") <= _whole(F.col("budget") - F.col("before")) * _whole("weight"))
    spent = F.sum(F.when(F.col("full"), F.col("capacity")).otherwise(0)).over(order)
    open_ = F.sum(F.when(F.col("full"), 0).otherwise(F.col("weight"))).over(order)
    c = c.withColumn("rest", F.col("budget") - spent).withColumn("open", open_)
    part = F.call_function("least", F.col("capacity"), F.expr("(CAST(rest AS DECIMAL(38,0)) * CAST(weight AS DECIMAL(38,0))) div nullif(open, 0)"))
    return c.withColumn("budget", F.when(F.col("full"), F.col("capacity")).otherwise(part)).drop("before", "later", "full", "rest", "open")


def leaf_budgets(leaves: DataFrame, weights: DataFrame, levels: list[str], fraction: float, epochs: int, default_weight: int = 1) -> DataFrame:
    """(levels..., tokens, budget) of leaves(levels..., tokens): whole tokens, rounded down at every level.

    weights(levels..., weight) has one row per node, with NULL in the levels below it; a node without a row weighs
    `default_weight`, one of weight 0 gets nothing.
    """
    nodes = leaves.withColumn("capacity", F.col("tokens") * epochs)
    budget = leaves.agg(F.floor(F.coalesce(F.sum("tokens"), F.lit(0)) * fraction).cast("long").alias("budget"))
    up: DataFrame | None = None
    for i, key in enumerate(levels):
        path = levels[:i + 1]
        own = weights.where(F.expr(" AND ".join([f"`{c}` IS NOT NULL" for c in path] + [f"`{c}` IS NULL" for c in levels[i + 1:]])))
        own = own.groupBy(*path).agg(F.max("weight").cast("long").alias("weight"))
        level = nodes.groupBy(*path).agg(F.sum("capacity").alias("capacity")).join(own, path, "left")
        level = level.withColumn("weight", F.coalesce("weight", F.lit(default_weight).cast("long")))
        level = level.crossJoin(F.broadcast(budget)) if up is None else level.join(up, levels[:i])  # `budget` is one row
        up = cut_lineage(_share(level, levels[:i], key).select(*path, "budget"))
    return leaves.join(up, levels)


def _order(seed: int, epoch: Column, id: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(id.cast("string"), F.lit(""))))


def mix(
    docs: DataFrame, weights: DataFrame, levels: dict[str, Column], id: str = "doc_id", tokens: Column | None = None,
    fraction: float = 0.5, epochs: int = 2, seed: int = 1, default_weight: int = 1,
) -> DataFrame:
    """docs' rows chosen for the mixture, once per epoch, as (row: struct of all columns, levels..., epoch, n_tokens).

    levels names the tree's levels, top first, with the expression that gives each; NULL counts as the empty name.
    The total budget is `fraction` of all tokens. Whole documents are taken: the one in which a leaf's budget ends
    is the last. Rows with the same id, or none, have one place in the order and are taken together. Documents without
    tokens cost nothing and come along inside the prefix; leaves without tokens give none. An empty table gives
    no rows. Names of docs' columns may clash with the levels.
    """
    tokens = word_tokens() if tokens is None else tokens
    names = list(levels)
    keyed = docs.select(
        *[F.coalesce(c.cast("string"), F.lit("")).alias(n) for n, c in levels.items()],
        F.col(id).alias("id_"), tokens.cast("long").alias("n_tokens"), F.struct(*docs.columns).alias("row"))
    digest = cut_lineage(keyed.drop("row"))
    leaves = cut_lineage(digest.groupBy(*names).agg(F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("tokens")))
    w = weights.select(*names, "weight")
    budgets = leaf_budgets(leaves, w, names, fraction, epochs, default_weight)
    budgets = cut_lineage(budgets.where("budget > 0").selectExpr(*names, "budget div tokens AS full", "budget % tokens AS part"))

    at = digest.join(budgets, names).withColumn("h", _order(seed, F.col("full"), F.col("id_")))
    slices = at.groupBy(*names, "part", F.substring("h", 1, 3).alias("slice")).agg(F.sum("n_tokens").alias("n"))
    by = Window.partitionBy(*names).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.withColumn("before", F.coalesce(F.sum("n").over(by), F.lit(0)))
    last = cut_lineage(slices.where("before < part").groupBy(*names).agg(F.max_by(F.struct("slice", "before"), "slice").alias("s")).select(*names, "s.*"))
    inside = at.withColumn("slice", F.substring("h", 1, 3)).join(last, [*names, "slice"])
    units = inside.groupBy(*names, "part", "before", "h").agg(F.sum("n_tokens").alias("n"))
    by = Window.partitionBy(*names).orderBy("h").rowsBetween(Window.unboundedPreceding, -1)
    units = units.withColumn("before", F.col("before") + F.coalesce(F.sum("n").over(by), F.lit(0)))
    ends = units.where("before < part").groupBy(*names).agg(F.max("h").alias("end"))
    cuts = cut_lineage(budgets.join(ends, names, "left").select(*names, "full", F.coalesce("end", F.lit("")).alias("end")))

    out = keyed.join(cuts, names).withColumn("more", (_order(seed, F.col("full"), F.col("id_")) <= F.col("end")).cast("int"))
    out = out.where("full + more > 0").withColumn("epoch", F.explode(F.sequence(F.lit(0).cast("long"), F.col("full") + F.col("more") - 1)))
    return out.select("row", *names, "epoch", "n_tokens")
