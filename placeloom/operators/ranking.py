"""Ranking, quotas, interleaving and greedy selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from placeloom.functions import keys as K
from placeloom.operators.scale import first_per_key, rank_within, top_k


def pick_sources(cands: DataFrame, k: int = 6, per_domain: int = 2) -> DataFrame:
    """Best candidate per url, at most `per_domain` per domain, first k per place; ties by url."""
    best = first_per_key(cands, ["place_id", "url"], [F.desc("score"), F.asc("position")])
    best = best.withColumn("domain", K.bare_domain("url"))
    spread = top_k(best, ["place_id", "domain"], [F.desc("score"), F.asc("url")], per_domain, "domain_rank")
    return top_k(spread, ["place_id"], [F.desc("score"), F.asc("url")], k, "rank")


def pick_diverse(cands: DataFrame, k: int = 4) -> DataFrame:
    """First the best row of every channel, then fill by score.

    Only the first k rows of a channel can be picked, so the channel rank is taken on a group-limited input.
    """
    best = first_per_key(cands, ["place_id", "url"], [F.desc("score"), F.asc("position")])
    ranked = top_k(best, ["place_id", "channel"], [F.desc("score"), F.asc("url")], k, "channel_rank")
    return top_k(ranked, ["place_id"], [F.expr("channel_rank > 1"), F.desc("score"), F.asc("url")], k, "rank")


def interleave(rows: DataFrame, channels: list[str], order: list[Column | str], key: str = "place_id") -> DataFrame:
    """Round-robin over channels in the given order: 1-based position per key."""
    place_in = F.array_position(F.array(*[F.lit(c) for c in channels]), F.col("channel")).cast("int")
    turn = rank_within(rows.where(F.col("channel").isin(channels)), [key, "channel"], order, "turn")
    return rank_within(turn.withColumn("_seat", place_in), [key], ["turn", "_seat"], "position").drop("_seat")


def renumber(rows: DataFrame, key: str, order: list[Column | str], name: str = "new_order") -> DataFrame:
    """Dense 0-based order inside each key."""
    return rank_within(rows, [key], order, "_pos").withColumn(name, F.col("_pos") - 1).drop("_pos")


def append_to_free_slots(existing: DataFrame, incoming: DataFrame, quota: Column | int) -> DataFrame:
    """New urls that fit into the free slots of their place; order goes on after the existing rows.

    incoming(place_id, url, seq[, category]); a url already present, or repeated, takes no slot.
    """
    have = existing.groupBy("place_id").agg(F.count(F.lit(1)).alias("have"))
    fresh = first_per_key(incoming, ["place_id", "url"], ["seq"])
    fresh = fresh.join(existing.select("place_id", "url").distinct(), ["place_id", "url"], "left_anti")
    most = quota if isinstance(quota, int) else None
    quota = F.lit(quota) if isinstance(quota, int) else quota
    fresh = fresh.join(have, "place_id", "left").withColumn("have", F.coalesce("have", F.lit(0)))
    w = Window.partitionBy("place_id").orderBy("seq", "url")
    ranked = fresh.withColumn("slot", F.row_number().over(w))
    if most is not None:  # lets Spark cut every task's share before the shuffle
        ranked = ranked.where(F.col("slot") <= most)
    return ranked.where(F.col("slot") <= F.greatest(F.lit(0), quota - F.col("have"))).withColumn(
        "sort_order", (F.col("have") + F.col("slot") - 1).cast("long"))


def even_sample(
    rows: DataFrame, n: int, order: list[Column | str], pinned: DataFrame | None = None, all_pinned: bool = False
) -> DataFrame:
    """n rows at evenly spaced positions with the pinned ids kept, in the original order (column `pos`).

    The first n of more than n pinned rows; with `all_pinned` every one of them.
    """
    total = rows.count()
    if n <= 0 or total <= n:
        return rank_within(rows, [], order, "pos")
    if pinned is None:
        rest, fixed, slots = rows, None, n
    else:
        fixed = rows.join(pinned, "id", "left_semi")
        fixed = fixed if all_pinned else top_by(fixed, order, n)
        slots = n - fixed.count()
        rest = rows.join(pinned, "id", "left_anti")
    chosen = None
    if slots > 0:
        m = rest.count()
        placed = rank_within(rest, [], order, "_p").withColumn("_p", F.col("_p") - 1)
        # position p is floor(i*m/slots) for some i exactly when this quotient steps between p-1 and p
        step = F.floor(((F.col("_p") + 1) * slots - 1) / F.lit(m)) > F.floor((F.col("_p") * slots - 1) / F.lit(m))
        chosen = placed.where(step).drop("_p")
    if fixed is not None:
        chosen = fixed if chosen is None else chosen.unionByName(fixed)
    return rank_within(chosen, [], order, "pos")


def top_by(rows: DataFrame, order: list[Column | str], n: int) -> DataFrame:
    return rows.orderBy(*order).limit(n)


def shard(rows: DataFrame, n: int, order: list[Column | str]) -> DataFrame:
    """shard = sorted position modulo n."""
    return rank_within(rows, [], order, "_p").withColumn("shard", F.pmod(F.col("_p") - 1, F.lit(n)).cast("int")).drop("_p")


def expand_ranges(spec: str) -> Column:
    """'17-19 22' → array(17, 18, 19, 22)."""
    tokens = F.split(F.trim(F.lit(spec)), r"\s+")
    return F.flatten(F.transform(tokens, lambda t: F.sequence(
        F.substring_index(t, "-", 1).cast("int"), F.substring_index(t, "-", -1).cast("int"))))


def reconcile_namespace(photos: DataFrame, incoming: DataFrame, prefix: str, cap: int = 10, mode: str = "append") -> DataFrame:
    """Desired photo list of every place named in `incoming`, row by row, with the row's action.

    append  : photos outside the url prefix stay; the incoming ones follow them, up to `cap` in all
    replace : the incoming ones are the whole list
    first   : the incoming ones come first and the photos outside the prefix are renumbered after them
    action  : keep / add / remove / reorder; a place without any other action than keep needs no write
    """
    named = incoming.select("place_id").distinct()
    mine = photos.join(named, "place_id", "left_semi")
    outside = mine.where(~F.col("url").startswith(prefix)) if mode != "replace" else mine.limit(0)
    n_in = incoming.groupBy("place_id").agg(F.count(F.lit(1)).alias("n_in"))
    n_out = outside.groupBy("place_id").agg(F.count(F.lit(1)).alias("n_out"))
    inc = rank_within(incoming, ["place_id"], ["seq", "url"], "i").join(n_out, "place_id", "left").withColumn(
        "n_out", F.coalesce("n_out", F.lit(0)))
    shift = F.col("n_out") if mode == "append" else F.lit(0)
    new = inc.where(shift + F.col("i") <= cap).select(
        "place_id", K.stable_id("photo", "place_id", "url").alias("photo_id"), "url", (shift + F.col("i") - 1).cast("long").alias("want"))
    if mode == "first":
        kept = rank_within(outside, ["place_id"], ["sort_order", "photo_id"], "i").join(n_in, "place_id")
        keep = kept.select("place_id", "photo_id", "url", (F.col("n_in") + F.col("i") - 1).cast("long").alias("want"))
    else:
        keep = outside.select("place_id", "photo_id", "url", F.col("sort_order").cast("long").alias("want"))
    desired = keep.unionByName(new)
    have = mine.select("place_id", "photo_id", F.col("url").alias("have_url"), F.col("sort_order").cast("long").alias("have"))
    both = desired.join(have, ["place_id", "photo_id"], "full_outer")
    action = (F.when(F.col("want").isNull(), "remove").when(F.col("have").isNull(), "add")
              .when(F.col("want") != F.col("have"), "reorder").otherwise("keep"))
    return both.select("place_id", "photo_id", F.coalesce("url", "have_url").alias("url"), "want", action.alias("action"))
