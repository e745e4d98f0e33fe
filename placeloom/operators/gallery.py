"""Photo scoring and gallery selection."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from placeloom import dims
from placeloom.functions.text import SPACE
from placeloom.operators.graph import keep_first
from placeloom.operators.scale import rank_within, skew_join
from placeloom.session import cut_lineage, drop_step

SMALL_KEY = 64  # distinct hashes of a key up to which all of them meet

def top_label(labels: Column, names: list[str]) -> Column:
    """Largest confidence among the named labels of a map; 0 when none is present."""
    return F.greatest(F.lit(0.0), *[F.coalesce(F.element_at(labels, n), F.lit(0.0)) for n in names])


def one(labels: Column, name: str) -> Column:
    return F.coalesce(F.element_at(labels, name), F.lit(0.0))


def is_exterior(labels: Column) -> Column:
    ext, inn = top_label(labels, dims.EXTERIOR_LABELS), top_label(labels, dims.INTERIOR_LABELS)
    seen = (one(labels, "outdoor") >= 0.3) | (one(labels, "building") >= 0.28) | (one(labels, "storefront") >= 0.28)
    return (ext >= 0.35) & (inn < 0.32) & seen


def _edges(t):
    x1, y1 = t["x"] + t["width"], t["y"] + t["height"]
    return x1, y1, (t["x"] < 0.16) | (x1 > 0.84) | (t["y"] < 0.16) | (y1 > 0.84)


def _explicit(t):
    words = F.regexp_replace(t["text"], f"{SPACE}+", "")
    return words.rlike(dims.WATERMARK_WORDS) | (words.rlike(dims.DATE_STAMP) & _edges(t)[2])


def watermark_texts(texts: Column) -> Column:
    """Texts that look like a mark: named sources, date stamps at the edge."""
    return F.filter(texts, lambda t: (t["confidence"] >= 0.25) & _explicit(t))


def edge_texts(texts: Column) -> Column:
    """Small texts at the edge that are no explicit mark."""
    return F.filter(texts, lambda t: (t["confidence"] >= 0.25) & ~_explicit(t) & _edges(t)[2]
                    & (t["height"] <= 0.055) & (t["width"] <= 0.34))


def is_close_person(faces: Column, humans: Column) -> Column:
    big = lambda a: F.coalesce(F.array_max(F.transform(a, lambda v: v["area"])), F.lit(0.0))
    return (big(faces) >= 0.012) | (big(humans) >= 0.4)


def content_score(category: Column, labels: Column, face_count: Column, human_count: Column, marks: Column, edge_count: Column) -> Column:
    inn, ppl = top_label(labels, dims.INTERIOR_LABELS), top_label(labels, dims.PEOPLE_LABELS)
    fac, food = top_label(labels, dims.FACILITY_LABELS), top_label(labels, dims.FOOD_LABELS)
    base = inn * 7 + ppl * 4 + fac * 3 + F.least(F.lit(2.0), face_count * 0.5 + human_count * 0.7)
    off_topic = (food > 0.65) & (inn < 0.25) & (top_label(labels, dims.SHELF_LABELS) < 0.25)
    library = (one(labels, "bookshelf") * 4 + one(labels, "library") * 3 + one(labels, "book") * 2 + one(labels, "desk") * 2
               - F.when(off_topic, 20).otherwise(0))
    other = one(labels, "restaurant") * 4 + food * 2 + one(labels, "table") * 2 + one(labels, "chair") * 2
    paper = (one(labels, "document") > 0.6) & (inn < 0.25) & (ppl < 0.25)
    return (base + F.when(category == "图书馆", library).otherwise(other) - F.when(is_exterior(labels), 1.5).otherwise(0.0)
            - F.when(paper, 7).otherwise(0) - F.when(marks > 0, 12).otherwise(0) - F.least(F.lit(3), edge_count) * 0.8)


def focus(labels: Column) -> Column:
    """exterior, or the strongest of five subjects; the earlier subject wins a tie."""
    extra = [n for n in dims.FACILITY_LABELS if n not in ("bookshelf", "table", "chair", "desk")]
    subjects = [("people", dims.PEOPLE_LABELS), ("seating", dims.SEATING_LABELS), ("shelves", dims.SHELF_LABELS),
                ("facility", extra), ("food", dims.FOOD_LABELS)]
    scored = F.array(*[F.struct(top_label(labels, names).alias("s"), F.lit(-i).alias("i"), F.lit(n).alias("n"))
                       for i, (n, names) in enumerate(subjects)])
    return F.when(is_exterior(labels), "exterior").otherwise(F.array_max(scored)["n"])


def crop_ratios(items: Column) -> Column:
    """struct(left, right, top, bottom): the border to cut so that the marks go, 12 % to 22 %."""
    def side(t):
        x1, y1 = t["x"] + t["width"], t["y"] + t["height"]
        options = F.array_compact(F.array(
            F.when(t["x"] < 0.24, F.struct((x1 + 0.025).alias("a"), F.lit("left").alias("s"))),
            F.when(x1 > 0.76, F.struct((1 - t["x"] + 0.025).alias("a"), F.lit("right").alias("s"))),
            F.when(t["y"] < 0.24, F.struct((y1 + 0.025).alias("a"), F.lit("bottom").alias("s"))),
            F.when(y1 > 0.76, F.struct((1 - t["y"] + 0.025).alias("a"), F.lit("top").alias("s")))))
        return F.array_min(options)

    cuts = F.transform(items, side)

    def widest(s):
        amounts = F.transform(F.filter(cuts, lambda c: c["s"] == s), lambda c: F.least(F.lit(0.22), F.greatest(F.lit(0.12), c["a"])))
        return F.greatest(F.lit(0.12), F.coalesce(F.array_max(amounts), F.lit(0.12))).alias(s)

    return F.struct(*[widest(s) for s in ("left", "right", "top", "bottom")])


def cross_place_content(photos: DataFrame) -> DataFrame:
    """Digests that occur at more than one place: min and max place differ, a mergeable test."""
    g = photos.groupBy("digest").agg(F.min("place_id").alias("lo"), F.max("place_id").alias("hi"))
    return g.where("lo <> hi").select("digest")


def pick_gallery(photos: DataFrame, max_per_place: int = 5, d_limit: int = 8) -> DataFrame:
    """Greedy gallery with a reason per photo.

    photos(place_id, photo_id, score, sort_order, close_person, blocked, exterior, dhash, phash, vector, focus,
    has_people). The greedy scan (score desc, sort_order, id) keeps at most `max_per_place` photos per place, so
    it is run as that many rounds: in each round every place's first acceptable open photo is found by a partial
    minimum, and the open photos are tested against the photo kept last. The state that travels is one row per
    place; the photos of a place are never gathered.
    """
    order = F.struct((-F.col("score")).alias("s"), F.col("sort_order").alias("o"), F.col("photo_id").alias("p"))
    size = photos.groupBy("place_id").agg(F.count(F.lit(1)).alias("pool"))
    rows = skew_join(photos, size, ["place_id"]).withColumn("ord", order)
    rows = rows.withColumn("reason", F.when(F.col("close_person"), "close_person").when(
        F.col("blocked"), "manual_or_cross_place_duplicate"))
    fixed = cut_lineage(rows.where("reason is not null").select("place_id", "photo_id", "reason"))
    # the state below is what the scan knows about the photos kept so far, updated once per round
    state = cut_lineage(
        rows.where("reason is null").withColumns({"ext_taken": F.lit(False), "near": F.lit(False), "same_focus": F.lit(0)}))
    kept = None
    settled = fixed
    for turn in range(max_per_place):
        # reasons in scan order; the last two can only apply to a photo that no earlier reason removed
        why = (
            F.when(F.col("exterior") & F.col("ext_taken"), "extra_exterior").when(F.col("near"), "near_duplicate")
            .when((F.col("same_focus") >= 2) & (F.col("pool") > max_per_place), "repeated_content")
            .when(F.col("score") < -1, "low_relevance_or_watermark"))
        judged = state.withColumn("why", why)
        head = judged.where("why is null").groupBy("place_id").agg(
            F.min_by(F.struct("ord", "photo_id", "exterior", "dhash", "phash", "vector", "focus"), "ord").alias("k"))
        head = cut_lineage(head)
        if head.isEmpty():
            break
        pick = head.select("place_id", F.col("k.photo_id").alias("photo_id"), F.lit(turn).alias("turn"))
        kept = pick if kept is None else kept.unionByName(pick)
        j = skew_join(judged, head, ["place_id"], "left")
        before = F.col("k").isNull() | (F.col("ord") < F.col("k.ord"))
        # photos passed over before the new one keep the reason they had then
        passed = j.where(before).select("place_id", "photo_id", F.col("why").alias("reason"))
        settled = settled.unionByName(cut_lineage(passed))
        rest = j.where(~before & (F.col("photo_id") != F.col("k.photo_id")))
        older, state = state, cut_lineage(rest.select(
            *[c for c in state.columns if c not in ("ext_taken", "near", "same_focus")],
            (F.col("ext_taken") | F.col("k.exterior")).alias("ext_taken"),
            (F.col("near") | looks_same("k.", d_limit)).alias("near"),
            (F.col("same_focus") + F.when(F.col("focus") == F.col("k.focus"), 1).otherwise(0)).alias("same_focus"),
        ))
        drop_step(older)
    full = None if kept is None else kept.groupBy("place_id").agg(F.count(F.lit(1)).alias("n"))
    if full is None:
        left = state.select("place_id", "photo_id", F.lit("low_relevance_or_watermark").alias("reason"))
        kept = photos.select("place_id", "photo_id", F.lit(0).alias("turn")).limit(0)
    else:
        why = (
            F.when(F.coalesce("n", F.lit(0)) >= max_per_place, "over_limit")
            .when(F.col("exterior") & F.col("ext_taken"), "extra_exterior").when(F.col("near"), "near_duplicate")
            .when((F.col("same_focus") >= 2) & (F.col("pool") > max_per_place), "repeated_content")
            .otherwise("low_relevance_or_watermark"))
        left = skew_join(state, full, ["place_id"], "left").select("place_id", "photo_id", why.alias("reason"))
    removed = settled.unionByName(left).where("reason is not null")
    chosen = photos.join(kept.select("place_id", "photo_id"), ["place_id", "photo_id"])
    w = Window.partitionBy("place_id").orderBy("exterior", F.desc("has_people"), F.desc("score"), "photo_id")
    chosen = chosen.select("place_id", "photo_id", (F.row_number().over(w) - 1).alias("new_order"))  # <= max_per_place rows a key
    return chosen.withColumn("reason", F.lit("kept")).unionByName(
        removed.withColumn("new_order", F.lit(None).cast("int")).select("place_id", "photo_id", "new_order", "reason"))


def looks_same(prefix: str, d_limit: int = 8, p_limit: int = 10, corr: float = 0.94) -> Column:
    """Near-duplicate test of two fingerprints: either hash close, or the thumbnails correlate."""
    other = lambda c: F.col(prefix + c)
    dot = F.aggregate(F.zip_with("vector", other("vector"), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    mean = F.when(F.size("vector") > 0, dot / F.size("vector")).otherwise(0.0)
    return ((F.bit_count(F.col("dhash").bitwiseXOR(other("dhash"))) <= d_limit)
            | (F.bit_count(F.col("phash").bitwiseXOR(other("phash"))) <= p_limit) | (mean >= corr))


def close_hashes(rows: DataFrame, limit: int = 7, key: str = "place_id", hash_col: str = "dhash", small: int = SMALL_KEY) -> DataFrame:
    """Pairs of distinct hash values per key within `limit` differing bits: (key, ha, hb), ha < hb.

    The 64 bits are cut into limit // 2 + 1 bands (two at least). Two values within the limit differ by one bit at most in
    some band, so a value is filed under each of its bands and asks with each band as it is and with any one of its
    bits flipped. At 7 bits those are 4 bands of 65 536 values and 68 askings; a pair is given out by the first band
    where it meets, so none comes twice. Keys of up to `small` values need fewer pairs than askings and all their
    values meet; both ways give the same rows. Equal values are merged first: a group of exact copies is one value here.
    NULL keys and NULL hashes are in no pair.
    """
    n = max(limit // 2 + 1, 2)
    width = -(-64 // n)
    widths = [min(width, 64 - i * width) for i in range(n)]
    values = cut_lineage(rows.select(key, F.col(hash_col).alias("h")).where(F.col("h").isNotNull()).distinct())
    size = values.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    sized = skew_join(values, size, [key])
    few, many = sized.where(F.col("n") <= small).select(key, "h"), sized.where(F.col("n") > small).select(key, "h")
    differ = F.col("ha").bitwiseXOR(F.col("hb"))
    close = (F.col("ha") < F.col("hb")) & (F.bit_count(differ) <= limit)
    plain = few.withColumnRenamed("h", "ha").join(few.withColumnRenamed("h", "hb"), key).where(close)

    def band(h, i):
        return F.shiftrightunsigned(h, i * width).bitwiseAND(F.lit((1 << widths[i]) - 1))

    filed = F.array(*[F.struct(F.lit(i).alias("i"), band("h", i).alias("v")) for i in range(n)])
    asked = F.array(*[
        F.struct(F.lit(i).alias("i"), band("h", i).bitwiseXOR(F.lit(flip).cast("long")).alias("v"))
        for i in range(n) for flip in (0, *(1 << b for b in range(widths[i])))])
    cells = many.withColumn("b", F.explode(filed)).select(key, F.col("h").alias("hb"), "b.i", "b.v")
    asks = many.withColumn("b", F.explode(asked)).select(key, F.col("h").alias("ha"), "b.i", "b.v")
    first = F.coalesce(*[F.when(F.bit_count(band(differ, i)) <= 1, i) for i in range(n)])
    met = skew_join(asks, cells, [key, "i", "v"]).where(close & (F.col("i") == first))
    return plain.unionByName(met.select(key, "ha", "hb"))


def thin_near_copies(rows: DataFrame, order: Column, limit: int = 7, key: str = "place_id") -> DataFrame:
    """Keep-first over Hamming neighbours per key: rows(id, key, dhash) → (id, kept, blocked_by).

    Equal hashes form a clique settled from its first row. Different but close values conflict through the first
    row of each value only when that is exact: value-level edges are expanded to the rows of the later value.
    """
    r = cut_lineage(rows.select("id", key, "dhash", order.alias("ord")))
    pairs = close_hashes(r, limit, key)
    one_way = pairs.select(key, F.col("ha").alias("dhash"), F.col("hb").alias("other"))
    both = one_way.unionByName(pairs.select(key, F.col("hb").alias("dhash"), F.col("ha").alias("other")))
    # equal values share all neighbours: whichever row of a value is open first decides for the value,
    # so the value's first row stands for it and the rows behind it follow
    value = r.groupBy(key, "dhash").agg(F.min(F.struct("ord", "id")).alias("f")).select(
        key, "dhash", F.col("f.ord").alias("ord"), F.col("f.id").alias("id"))
    a = value.select(key, "dhash", F.col("id").alias("ida"), F.col("ord").alias("oa"))
    b = value.select(key, F.col("dhash").alias("other"), F.col("id").alias("idb"), F.col("ord").alias("ob"))
    edges = both.join(a, [key, "dhash"]).join(b, [key, "other"]).where(F.struct("oa", "ida") < F.struct("ob", "idb"))
    heads = keep_first(value.select("id", "ord", F.lit(None).cast("string").alias("clique")),
                       edges.select(F.col("ida").alias("earlier"), F.col("idb").alias("later")))
    state = value.select(key, "dhash", F.col("id").alias("head")).join(heads.withColumnRenamed("id", "head"), "head")
    out = skew_join(r, state, [key, "dhash"])
    same = F.col("id") == F.col("head")
    return out.select(
        "id", key, (F.col("kept") & same).alias("kept"),
        F.when(same, F.col("blocked_by")).otherwise(F.coalesce("blocked_by", "head")).alias("blocked_by"))


def usable_image(url, title_key: Column, aliases: Column, width, height, entropy, blocked_parts: list[str], min_side: int = 480) -> Column:
    """https only, no blocked host part, an alias in the title, large enough, not a strip, not flat."""
    u = F.col(url) if isinstance(url, str) else url
    host_path = F.lower(F.concat(F.coalesce(F.try_parse_url(u, F.lit("AUTHORITY")), F.lit("")),
                                 F.coalesce(F.try_parse_url(u, F.lit("PATH")), F.lit(""))))
    w, h, e = (F.col(c) if isinstance(c, str) else c for c in (width, height, entropy))
    blocked = reduce(lambda a, b: a | b, [host_path.contains(p) for p in blocked_parts], F.lit(False))
    return (u.startswith("https://") & ~blocked & F.exists(aliases, lambda a: title_key.contains(a))
            & (F.least(w, h) >= min_side) & (F.greatest(w, h) <= 3.2 * F.least(w, h)) & (e >= 3.2))


def best_note_images(images: DataFrame, k: int = 3, first_urls: int = 12) -> DataFrame:
    """k best images per note among its first distinct urls; the cover image is marked down."""
    once = images.groupBy("note_id", "url").agg(F.min_by(F.struct("idx", "width", "height", "entropy"), "idx").alias("i"))
    once = once.select("note_id", "url", "i.*")
    w = Window.partitionBy("note_id").orderBy("idx", "url")
    head = once.withColumn("n", F.row_number().over(w)).where(F.col("n") <= first_urls)
    short, ratio = F.least("width", "height"), F.col("width") / F.greatest(F.lit(1), F.col("height"))
    good = head.where((short >= 720) & (ratio >= 0.45) & (ratio <= 2.2) & (F.col("entropy") >= 2.5))
    good = good.withColumn("score", short + F.col("entropy") * 100 - F.when(F.col("n") == 1, 180).otherwise(0))
    v = Window.partitionBy("note_id").orderBy(F.desc("score"), "url")
    return good.withColumn("rank", F.row_number().over(v)).where(F.col("rank") <= k)
