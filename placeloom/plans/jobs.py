"""The jobs a user calls: operators put together, DataFrames in, DataFrames out."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, Window, functions as F

from placeloom import dims
from placeloom.functions import geo, keys as K, text as T
from placeloom.operators import audit as A, duplicates as DUP, evidence as EV, gallery as G, gate as GT, matching as M
from placeloom.operators import ranking as R, sync
from placeloom.operators.grid import HOT_CELL, nearest, ordered_boxes, points_in_boxes
from placeloom.operators.scale import keep_value, rank_within, skew_join, top_k
from placeloom.operators.select import by_categories
from placeloom.session import cut_lineage
from placeloom.sources import files


def audit_places(places: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(findings, counts) of the record audit and the exact-duplicate search."""
    found = A.audit_places(places)
    return found, A.issue_counts(found)


class Resolution(NamedTuple):
    edges: DataFrame
    groups: DataFrame
    merged: DataFrame
    photos: DataFrame
    removed: DataFrame


def resolve_duplicates(places: DataFrame, photos: DataFrame) -> Resolution:
    """Evidence edges, groups, merged records, re-parented photos and the ids that go; nothing is changed in place.

    The groups come from enough links to tell them, so the list of all edges is no step on their way."""
    units, members = DUP.signatures(places)
    parts = DUP.evidence_parts(units)
    edges = DUP.duplicate_edges(units, parts)  # grows as the square of a crowd at one address; made where it is read
    groups = cut_lineage(DUP.duplicate_groups(units, members, DUP.duplicate_links(units, parts)))
    rows = DUP.with_photo_count(places, photos).withColumn("completeness", DUP.completeness()).join(groups, "id")
    rows = cut_lineage(rows)
    canon = DUP.canonical_choice(rows)
    merged = DUP.merge_groups(rows, canon)
    link = rows.select(F.col("id").alias("place_id"), "group_id", F.col("updated_at").alias("member_updated_at")).join(
        canon.select("group_id", "canonical_id"), "group_id")
    moved = DUP.merge_photos(photos.select("place_id", "photo_id", "url", "sort_order").join(link, "place_id"))
    removed = link.where("place_id <> canonical_id").select(F.col("place_id").alias("id"), "canonical_id")
    return Resolution(edges, groups, merged, moved, removed)


def verify_candidates(
    places: DataFrame, cands: DataFrame, current: DataFrame, fields: list[str], duplicates: bool = False
) -> tuple[DataFrame, DataFrame]:
    """(gate, actions): score map candidates, take the best accepted one, audit the moved record, diff with what is stored.

    Two approved records with one category, strict name and address end the run, unless duplicates are allowed.
    """
    p = places.select(F.col("id").alias("place_id"), "name", "category", "address", "latitude", "longitude")
    scored = M.score_candidates(skew_join(cands, M.parse_places(p), ["place_id"]))
    best = GT.best_accepted(scored)
    point = cands.select("place_id", "cand_no", F.col("cand_latitude").alias("new_lat"), F.col("cand_longitude").alias("new_lon"))
    best = best.join(point, ["place_id", "cand_no"]).withColumnRenamed("place_id", "id")
    rows = places.join(best, "id", "left").withColumn("latitude", F.coalesce("new_lat", "latitude")).withColumn(
        "longitude", F.coalesce("new_lon", "longitude"))
    gate = cut_lineage(GT.run_gate(rows.withColumn("map_status", F.lit("approved")).withColumn("has_source", F.lit(True))))
    approved = gate.where("stage = 'approved'")
    if not duplicates:
        GT.assert_no_exact_duplicates(approved)
    return gate.select("id", "stage", "reason"), sync.desired_state_diff(current, approved, fields)


def extract_evidence(pages: DataFrame, places: DataFrame, cap: int = 80, terms: list[str] = dims.FACILITY_TERMS) -> DataFrame:
    """Evidence lines per place and kind.

    pages(page_id, text, is_source, requested_url, result_url), places(id, alias). Pages whose answer URL is not
    the requested one are left out; a page counts for a place when it mentions it, and a search page's line
    only when its own context does. First `cap` different texts per place and kind.

    Every text is normalised once, and a line meets the places of its page as a digest; only the rows that stay get
    their context back.
    """
    good = pages.where((F.col("requested_url") == "") | (F.col("result_url") == "") | (K.request_key("requested_url") == K.request_key("result_url")))
    keyed = cut_lineage(good.select("page_id", T.alnum_key(F.array_join(F.transform(F.split("text", "\n"), T.clean_markdown), " ")).alias("key")))
    hits = cut_lineage(EV.mentions(keyed, places.select(F.col("id").alias("place_id"), "alias")))
    used = good.join(hits.select("page_id").distinct(), "page_id", "left_semi")
    lines = EV.with_context(used).where(~F.col("line").rlike(dims.PAGE_NOISE))
    lines = lines.join(good.select("page_id", "is_source"), "page_id")
    lines = lines.where(F.col("is_source") | ~F.col("context").rlike(dims.SEARCH_NOISE))
    kinds = EV.evidence_kinds(F.col("context"), F.col("is_source"), terms)
    lines = lines.select("page_id", "line_no", "is_source", "context", kinds.alias("kinds"), T.alnum_key("context").alias("ck"))
    lines = cut_lineage(lines.withColumn("digest", EV.text_digest(F.col("ck")))).where("size(kinds) > 0 AND digest IS NOT NULL")
    line = ["page_id", "line_no", "digest"]
    own = F.coalesce("is_source", F.lit(False))
    read = skew_join(lines.where(own).select(*line, "kinds"), hits, ["page_id"])
    asked = skew_join(lines.where(~own).select(*line, "kinds", "ck"), hits, ["page_id"])
    alias = places.select(F.col("id").alias("place_id"), "alias")
    asked = skew_join(asked, alias, ["place_id"]).where(F.col("ck").contains(F.col("alias"))).drop("ck", "alias")
    rows = read.unionByName(asked).withColumn("kind", F.explode("kinds")).drop("kinds")
    first = cut_lineage(EV.cap_evidence(rows, ["place_id", "kind"], ["page_id", "line_no"], cap, digest="digest"))
    texts = lines.join(first.select(*line).distinct(), line, "left_semi").groupBy(*line).agg(F.min("context").alias("context"))
    return first.join(texts, line).select("place_id", "kind", "page_id", "line_no", "context", "rank")


def curate_gallery(photo_features: DataFrame, max_per_place: int = 5) -> DataFrame:
    """Gallery decisions; photos whose content occurs at several places are blocked first."""
    shared = G.cross_place_content(photo_features).withColumn("shared", F.lit(True))
    rows = skew_join(photo_features, shared, ["digest"], "left").withColumn("blocked", F.coalesce("shared", F.lit(False)))
    return G.pick_gallery(rows.drop("shared", "digest"), max_per_place)


def rank_sources(links: DataFrame, names: DataFrame, k: int = 6, floor: int = 25) -> DataFrame:
    """links(place_id, raw_url, title, position) → the k best sources per place, at most two per domain."""
    parts = K.Parts("_parts")
    rows = links.select("place_id", "title", "position", K.url_parts("raw_url").alias(parts)).withColumn("host", K.url_host(parts))
    rows = keep_value(rows, "url", K.usable_source(parts)).drop(parts)
    rows = EV.with_source_score(rows, names, F.lit(""), "title").withColumn("s", F.col("score") - F.col("position")).drop("score")
    rows = keep_value(rows, "score", F.when(F.col("s") >= floor, F.col("s")))
    return R.pick_sources(rows.select("place_id", "url", "score", "position"), k)


def publish(places: DataFrame, photos: DataFrame, mirror: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(actions, documents to write) against mirror(id, pushed_fingerprint)."""
    fp = sync.with_fingerprint(places, photos)
    actions = cut_lineage(sync.publish_diff(fp, mirror))
    push = actions.where("action <> 'stale'").select("id")
    docs = files.publish_docs(files.nest_photos(
        places.join(push, "id", "left_semi"), photos.join(push.withColumnRenamed("id", "place_id"), "place_id", "left_semi")))
    return actions, docs


ID_RANGES = 512  # ranges of ids that a viewport's places are counted in
RANGE_ROWS = 100_000  # most places of a range


def viewport_query(viewports: DataFrame, places: DataFrame, categories: list[str] | None, limit: int) -> DataFrame:
    """Display places of a table of viewports: category filter, covered edges cut off, evenly spaced sample of at most
    `limit` per viewport in id order, each with its distance to the viewport's centre.

    Equal boxes are looked at once. A box's places are counted by ranges of ids, which says in which ranges its sample lies and
    at which places of them; only the places of these ranges are shuffled and numbered.
    """
    s, n = geo.inset_box(F.col("south"), F.col("north"), F.col("top_ratio"), F.col("bottom_ratio"))
    corners = ["south", "north", "west", "east"]
    views = ordered_boxes(viewports.select("vid", s.alias("south"), n.alias("north"), "west", "east"))
    # a viewport id that stands for several boxes has one sample over all of them
    lone = F.count(F.lit(1)).over(Window.partitionBy("vid")) == 1
    views = views.withColumn("_lone", lone).withColumn("_g", F.struct(*[F.when(F.col("_lone"), F.col(c)).alias(c) for c in corners], F.when(~F.col("_lone"), F.col("vid")).alias("vid")))
    views = cut_lineage(views)
    names = cut_lineage(views.select("_g").distinct().withColumn("box", F.monotonically_increasing_id()))
    views = cut_lineage(skew_join(views, names, ["_g"]).drop("_g"))
    boxes = views.where("_lone").dropDuplicates(["box"]).unionByName(views.where("NOT _lone")).select("box", *corners)

    mine = by_categories(places, categories).select("id", "latitude", "longitude")
    mine = cut_lineage(rank_within(mine, [], ["id", "latitude", "longitude"], "_no"))
    width = max(1, min(-(-mine.count() // ID_RANGES), RANGE_ROWS))
    mine = mine.withColumn("_range", F.floor((F.col("_no") - 1) / width).cast("int"))

    counts = points_in_boxes(mine, boxes, hot_rows=16 * HOT_CELL).groupBy("box", "_range").agg(F.count(F.lit(1)).alias("_n"))
    in_order = Window.partitionBy("box").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumns({"_before": F.coalesce(F.sum("_n").over(in_order), F.lit(0)), "total": F.sum("_n").over(Window.partitionBy("box"))})

    def taken(first):  # places of the sample before this position
        return F.floor((first * limit - 1) / F.col("total"))

    some = (F.col("total") <= limit) | (taken(F.col("_before") + F.col("_n")) > taken(F.col("_before")))
    ranges = F.map_from_entries(F.collect_list(F.struct("_range", "_before"))).alias("_ranges")  # at most `limit`
    wanted = cut_lineage(counts.where(some).groupBy("box").agg(F.max("total").alias("total"), ranges))

    seen = points_in_boxes(mine, skew_join(boxes, wanted, ["box"]), hot_rows=16 * HOT_CELL)
    seen = keep_value(seen, "_before", F.try_element_at("_ranges", F.col("_range"))).drop("_ranges")
    nth = F.row_number().over(Window.partitionBy("box", "_range").orderBy("_no"))
    rows = seen.withColumn("_p", F.col("_before") + nth - 1)
    shown = rows.where((F.col("total") <= limit) | (taken(F.col("_p") + 1) > taken(F.col("_p"))))
    d = geo.haversine_m((F.col("south") + F.col("north")) / 2, (F.col("west") + F.col("east")) / 2, "latitude", "longitude")
    shown = shown.select("box", "id", geo.js_round(d).alias("distance_m"), (F.col("total") > limit).alias("sampled"))
    return skew_join(shown, views.select("vid", "box").distinct(), ["box"]).select("vid", "id", "distance_m", "sampled")


def default_places(viewports: DataFrame, places: DataFrame, categories: list[str] | None) -> DataFrame:
    """Selected place per viewport: the nearest to its centre among those in view, else the nearest of the category."""
    mine = cut_lineage(by_categories(places, categories).select("id", "latitude", "longitude"))
    mid = [((F.col(a) + F.col(b)) / 2).alias(c) for a, b, c in (("south", "north", "latitude"), ("west", "east", "longitude"))]
    corners = ["south", "north", "west", "east"]
    seen = nearest(ordered_boxes(viewports.select("vid", *corners)).select("vid", *corners, *mid), mine, boxed=True).where("distance IS NOT NULL")
    best = cut_lineage(seen.groupBy("vid").agg(F.min(F.struct(F.col("distance").alias("d"), F.col("place_id").alias("id"))).alias("b")))
    inside = best.select("vid", F.col("b.id").alias("id"), F.lit(True).alias("in_view"))
    rest = nearest(viewports.select("vid", *mid).join(best.select("vid"), "vid", "left_anti"), mine)
    return inside.unionByName(rest.select("vid", F.col("place_id").alias("id"), F.lit(False).alias("in_view")))
