"""Staged approval gate and manual overlays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from placeloom.functions import rules, text as T
from placeloom.operators.scale import keep_value, rank_within, skew_join


def best_accepted(scored: DataFrame) -> DataFrame:
    """Accepted candidate per place: score, then the shorter movement, then the candidate number; a partial minimum."""
    order = F.struct((-F.col("score")).alias("s"), F.col("movement_m").alias("m"), F.col("cand_no").alias("cand_no"))
    # a plain filter would repeat the whole scoring
    g = keep_value(scored, "_ok", F.when(F.col("accepted"), True)).groupBy("place_id").agg(F.min(order).alias("b"))
    return g.select("place_id", F.col("b.cand_no").alias("cand_no"), (-F.col("b.s")).alias("score"), F.col("b.m").alias("movement_m"))


def run_gate(rows: DataFrame) -> DataFrame:
    """Stage and reason per record: map → audit → source → approved; column logic only."""
    issues = F.array_join(rules.record_issues(), ",")
    r = rows.withColumn("issues", issues)
    no_map = F.col("map_status") != "approved"
    no_cand = F.col("cand_no").isNull()
    stage = (F.when(no_map | no_cand, "map").when(F.col("issues") != "", "audit").when(~F.col("has_source"), "source").otherwise("approved"))
    reason = (F.when(no_map, F.col("map_status")).when(no_cand, "no_accepted_candidate").when(F.col("issues") != "", F.col("issues"))
              .when(~F.col("has_source"), "candidate_source_missing").otherwise(""))
    return r.withColumn("stage", stage).withColumn("reason", reason)


def strict_key(name) -> Column:
    return T.sub(F.lower(T.text(name)), (r"""[\s·•，,。.：:；;／/\\_\-—“”"'’]""", ""))


def approved_duplicates(approved: DataFrame) -> DataFrame:
    """(id, name, duplicate_of, original_id): approved records whose category, strict name and address an approved record
    with a smaller id has; one minimum a key, so a key of very many records is never gathered."""
    keyed = approved.select("id", "name", "category", strict_key("name").alias("n"), T.normalize_address("address").alias("a"))
    first = keyed.groupBy("category", "n", "a").agg(F.min(F.struct("id", "name")).alias("f"), F.count(F.lit(1)).alias("c")).where("c > 1")
    met = skew_join(keyed, first.select("category", "n", "a", "f"), ["category", "n", "a"]).where(F.col("id") != F.col("f.id"))
    return met.select("id", "name", F.col("f.name").alias("duplicate_of"), F.col("f.id").alias("original_id"))


def assert_no_exact_duplicates(approved: DataFrame) -> None:
    """Stop the run when two approved records share category, strict name and address."""
    n = approved_duplicates(approved).count()
    if n:
        raise ValueError(f"{n} approved records are exact duplicates")


def apply_selection(notes: DataFrame, overlay: DataFrame) -> DataFrame:
    """Pick images by reviewed 0-based indexes; positions outside the list are skipped, notes without a review left out."""
    j = notes.join(overlay, "note_id")
    picked = F.filter(F.transform("selected", lambda i: F.get(F.col("images"), i)), lambda v: v.isNotNull())
    return j.select("note_id", F.posexplode(picked).alias("i", "url")).select("note_id", (F.col("i") + 1).alias("pick"), "url")


def apply_rejections(photos: DataFrame, overlay: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(removed, renumbered, missing) of a list of rejected photos(photo_id, reason).

    removed: the photos on the list, with the reason. renumbered(place_id, photo_id, sort_order, new_order): all photos
    that the touched places keep, numbered anew from 0 by (sort_order, photo_id). missing: listed ids that no photo has.
    A photo listed twice is removed once, with the smallest reason.
    """
    listed = overlay.groupBy("photo_id").agg(F.min("reason").alias("reason"))
    removed = photos.join(listed, "photo_id")
    touched = removed.select("place_id").distinct()
    kept = skew_join(photos.join(listed, "photo_id", "left_anti"), touched, ["place_id"], "left_semi")
    order = rank_within(kept.select("place_id", "photo_id", "sort_order"), ["place_id"], ["sort_order", "photo_id"], "n")
    renumbered = order.select("place_id", "photo_id", "sort_order", (F.col("n") - 1).cast("int").alias("new_order"))
    return removed, renumbered, listed.join(photos, "photo_id", "left_anti")
