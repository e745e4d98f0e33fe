"""Fingerprints, diffs, snapshot merges and guard hashes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from placeloom.functions import keys as K
from placeloom.operators.covers import wiped
from placeloom.operators.scale import first_per_key, rank_within


def photo_digests(photos: DataFrame) -> DataFrame:
    """(id, photo_count, photo_digest): order-aware digest as a sum of per-position hashes.

    A sum is a partial aggregate, so a place with very many photos is not gathered; the position enters each
    hash, so order counts.
    """
    placed = rank_within(photos.select("place_id", "photo_id", "url", "sort_order"), ["place_id"], ["sort_order", "photo_id"], "pos")
    h = K.hash60(F.concat_ws("|", F.col("pos").cast("string"), F.col("url"))).cast("decimal(38,0)")
    return placed.groupBy(F.col("place_id").alias("id")).agg(
        F.count(F.lit(1)).alias("photo_count"), F.sum(h).alias("photo_digest"))


def with_fingerprint(places: DataFrame, photos: DataFrame) -> DataFrame:
    d = places.join(photo_digests(photos), "id", "left")
    d = d.withColumn("photo_count", F.coalesce("photo_count", F.lit(0))).withColumn(
        "photo_digest", F.coalesce("photo_digest", F.lit(0).cast("decimal(38,0)")))
    return d.withColumn("fingerprint", K.place_fingerprint("photo_count", "photo_digest"))


def publish_diff(fingerprints: DataFrame, mirror: DataFrame) -> DataFrame:
    """(id, action): push_missing, push_changed, stale. mirror(id, pushed_fingerprint)."""
    m = fingerprints.select("id", "fingerprint").join(mirror, "id", "full_outer")
    action = (
        F.when(F.col("fingerprint").isNull(), "stale").when(F.col("pushed_fingerprint").isNull(), "push_missing")
        .when(F.col("fingerprint") != F.col("pushed_fingerprint"), "push_changed"))
    return m.select("id", action.alias("action")).where("action is not null")


def desired_state_diff(current: DataFrame, desired: DataFrame, fields: list[str], managed: Column | None = None, key: str = "id") -> DataFrame:
    """(key, action, changed): create, update, delete (managed rows only), untracked; one full outer join."""
    c = current.select(key, F.struct(*fields).alias("c"), (managed if managed is not None else F.lit(True)).alias("managed"))
    d = desired.select(key, F.struct(*fields).alias("d"))
    j = c.join(d, key, "full_outer")
    changed = F.array_compact(F.array(*[F.when(~F.col(f"c.{f}").eqNullSafe(F.col(f"d.{f}")), F.lit(f)) for f in fields]))
    action = (
        F.when(F.col("c").isNull(), "create").when(F.col("d").isNull(), F.when(F.col("managed"), "delete").otherwise("untracked"))
        .when(F.size(changed) > 0, "update"))
    names = F.when(F.col("c").isNotNull() & F.col("d").isNotNull(), F.array_join(changed, ",")).otherwise("")
    return j.select(key, action.alias("action"), names.alias("changed")).where("action is not null")


def guard_hash(rows: DataFrame, group: list[str], fields: list[str]) -> DataFrame:
    """Row count and order-free content hash per group: equal before and after means nothing in it was touched."""
    h = F.sha2(F.concat_ws("\u001f", *[F.coalesce(F.col(f).cast("string"), F.lit("\u0000")) for f in fields]), 256)
    part = lambda i: F.conv(F.substring(h, i, 15), 16, 10).cast("decimal(38,0)")
    return rows.groupBy(*group).agg(
        F.count(F.lit(1)).alias("rows"), F.sum(part(1)).alias("hash_a"), F.sum(part(16)).alias("hash_b"))


def apply_snapshots(base: DataFrame, snapshots: DataFrame, snapshot_rows: DataFrame) -> DataFrame:
    """Replay viewport snapshots over a base load, all at once.

    snapshots(seq, complete, south, north, west, east); snapshot_rows(seq, id, ...base columns).
    A row written at version v is gone when a complete snapshot of a later version covers it; of the rest the
    last write per id stays. Base rows carry version 0 unless base has its own `seq`, as an earlier replay's result has: a
    replay may start from it with the later snapshots only. A view keeps one write of an id, so after it an older write
    elsewhere of a place that has moved no longer comes back when the newer one is wiped; otherwise both ways are equal.
    """
    cols = [c for c in base.columns if c != "seq"]
    seq = F.col("seq").cast("long") if "seq" in base.columns else F.lit(0).cast("long")
    written = base.select(*cols, seq.alias("seq")).unionByName(snapshot_rows.select(*cols, F.col("seq").cast("long").alias("seq")))
    wipes = snapshots.where("complete").select(F.col("seq").cast("long").alias("version"), "south", "north", "west", "east")
    left = written.join(wiped(written, wipes), ["id", "seq"], "left_anti")
    return first_per_key(left, ["id"], [F.desc("seq")])


def keep_last(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    """Union of sources with different columns; for one key the later source wins, within it the later row."""
    out = None
    for i, p in enumerate(parts):
        p = p.withColumn("source_no", F.lit(i))
        out = p if out is None else out.unionByName(p, allowMissingColumns=True)
    return first_per_key(out, keys, [F.desc("source_no"), F.desc("row_no")])


def refresh_from_list(places: DataFrame, source: DataFrame, overrides: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Changed fields per place from an authoritative list: override, else source, else current; missing sources flagged."""
    j = places.join(source.select(key, F.struct(*fields).alias("s")), key, "left").join(
        overrides.select(key, F.struct(*fields).alias("o")), key, "left")
    want = {f: F.coalesce(F.col(f"o.{f}"), F.col(f"s.{f}"), F.col(f)) for f in fields}
    changed = F.array_compact(F.array(*[F.when(~want[f].eqNullSafe(F.col(f)), F.lit(f)) for f in fields]))
    missing = F.col("s").isNull() & F.col("o").isNull()
    return j.select(
        "id", key, *[want[f].alias("new_" + f) for f in fields], F.array_join(changed, ",").alias("changed"),
        missing.alias("source_missing")).where("source_missing or changed <> ''")

