"""Near pairs, duplicate evidence, groups and survivorship merging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from placeloom import dims
from placeloom.functions import geo, text as T
from placeloom.operators.graph import components
from placeloom.operators.grid import CROWD, HOT_CELL, near_self_pairs
from placeloom.operators.scale import keep_value, rank_within, skew_join
from placeloom.session import cut_lineage


def completeness(kind: str = "merge", photos: str = "photo_count") -> Column:
    a, h, d = T.text("address"), T.text("hours"), T.text("description")
    n = F.coalesce(F.col(photos), F.lit(0))
    if kind == "merge":
        located = F.coalesce((F.col("latitude") != 0) & (F.col("longitude") != 0) & geo.finite("latitude", "longitude"), F.lit(False))
        return (F.when(located, 25).otherwise(0) + F.least(F.length(a), F.lit(20))
                + F.when((h != "") & (h != dims.ONSITE_HOURS), 10).otherwise(0) + F.when(d != "", 8).otherwise(0)
                + F.least(n * 3, F.lit(12))).cast("long")
    return (F.least(F.length(a), F.lit(35)) + F.when(h != "", 12).otherwise(0) + F.when(d != "", 12).otherwise(0)
            + F.least(n * 5, F.lit(20))).cast("long")


def with_photo_count(places: DataFrame, photos: DataFrame) -> DataFrame:
    n = photos.groupBy(F.col("place_id").alias("id")).agg(F.count(F.lit(1)).alias("photo_count"))
    return places.join(n, "id", "left").withColumn("photo_count", F.coalesce("photo_count", F.lit(0)))


# ---- near pairs of one category ----------------------------------------------

def near_duplicate_audit(places: DataFrame, photos: DataFrame, reviewed: DataFrame, radius: float = 60.0) -> DataFrame:
    """Same-category pairs within `radius` metres with evidence and review status.

    Records that agree in every compared value are one row with a copy count (first_id is the smallest id), so
    a place stored a million times gives one line "n copies", not n²/2 lines: a row with first_id = second_id
    stands for all pairs inside the copy group, any other row for first_copies × second_copies pairs. Records
    named in the reviewed list stay single, because their status differs.
    """
    named = reviewed.select(F.explode(F.array("first_id", "second_id")).alias("id")).distinct().withColumn("single", F.col("id"))
    rows = with_photo_count(places, photos).join(named, "id", "left").select(
        "id", "category", "latitude", "longitude", T.normalize_address("address").alias("addr"),
        T.road_number("address").alias("road"), T.normalize_name("name").alias("nm"),
        F.coalesce("single", F.lit("")).alias("single"), completeness("audit").alias("completeness"))
    unit = cut_lineage(
        rows.where(geo.finite("latitude", "longitude"))
        .groupBy("category", "latitude", "longitude", "addr", "road", "nm", "single")
        .agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"), F.max("completeness").alias("completeness")))
    # the reviewed partners of an id go with it, so that the pairs, which may be very many, are not shuffled to meet the list
    rev = reviewed.select(F.least("first_id", "second_id").alias("id"), F.greatest("first_id", "second_id").alias("other"), "reason")
    rev = rev.groupBy("id").agg(F.collect_list(F.struct("other", F.coalesce("reason", F.lit("")).alias("reason"))).alias("partners"))
    unit = cut_lineage(unit.join(rev, "id", "left").select(*unit.columns, "partners"))
    cross = near_self_pairs(unit, radius, ["category"], hot_rows=HOT_CELL)
    inner = unit.where("copies > 1").select(
        "category", F.lit(0.0).alias("distance"),
        *[F.col(c).alias(p + c) for p in ("a_", "b_") for c in unit.columns if c != "category"])
    pairs = cross.unionByName(inner)
    listed = F.transform(F.filter("a_partners", lambda x: x["other"] == F.col("b_id")), lambda x: x["reason"])
    pairs = pairs.withColumn("reason", F.explode(F.when(F.size(listed) > 0, listed).otherwise(F.array(F.lit("")))))
    same_addr = F.col("a_addr") == F.col("b_addr")  # two empty addresses count as equal here
    same_road = (F.col("a_road") != "") & (F.col("a_road") == F.col("b_road"))
    related = T.names_related(F.col("a_nm"), F.col("b_nm"))
    likely = (F.col("reason") == "") & (same_addr | (same_road & (F.col("distance") <= 45)) | related)
    return pairs.select(
        F.col("a_id").alias("first_id"), F.col("b_id").alias("second_id"), "category",
        F.col("a_copies").alias("first_copies"), F.col("b_copies").alias("second_copies"),
        geo.js_round(F.col("distance")).alias("distance_m"), same_addr.alias("same_address"),
        same_road.alias("same_road_number"), related.alias("related_name"), likely.alias("likely_duplicate"),
        F.when(F.col("reason") != "", "verified_distinct").when(likely, "unresolved").otherwise("different").alias("review_status"),
        F.col("a_completeness").alias("first_completeness"), F.col("b_completeness").alias("second_completeness"),
    )


# ---- duplicate evidence -------------------------------------------------------

RULES = [
    "same_address_related_name", "same_name_same_door", "same_name_near",
    "very_similar_name_120m", "similar_name_60m", "contained_name_80m",
]


def signatures(places: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(units, members): one unit per distinct compared content, and the unit of every place."""
    fields = dict(
        nm=T.dedupe_key("name"), addr=T.normalize_address("address", "dedupe"), door=T.street_number("address"),
        kids=T.text("name").contains("少儿"))
    rows = places.select("id", "category", "latitude", "longitude", *[v.alias(k) for k, v in fields.items()])
    content = ["category", "latitude", "longitude", *fields]
    members = cut_lineage(rows.withColumn("sig", F.xxhash64(*content)))
    units = members.groupBy("sig", *content).agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies")).drop("sig")
    units = cut_lineage(units)
    return units, members.drop("sig")


def _evidence(pairs: DataFrame) -> DataFrame:
    """Keep the pairs that meet one of the six rules and name the first one met."""
    a, b = (lambda c: F.col("a_" + c)), (lambda c: F.col("b_" + c))
    sim = T.similarity(a("nm"), b("nm"))
    both = (a("addr") != "") & (b("addr") != "")
    same_addr = both & (a("addr") == b("addr"))
    contained_addr = both & (F.least(F.length(a("addr")), F.length(b("addr"))) >= 6) & T.contains_either(a("addr"), b("addr"))
    exact = a("nm") == b("nm")
    door = (a("door") != "") & (a("door") == b("door"))
    inside = (F.least(F.length(a("nm")), F.length(b("nm"))) >= 4) & T.contains_either(a("nm"), b("nm"))
    d = F.col("distance")
    pairs = pairs.withColumn("distance", geo.haversine_m("a_latitude", "a_longitude", "b_latitude", "b_longitude", "zero"))
    pairs = pairs.where((a("kids") == b("kids")) | (a("addr") == b("addr"))).withColumn("similarity", sim)
    s = F.col("similarity")
    reach = F.when(F.col("category") == "食堂", 80).otherwise(250)
    rule = (
        F.when((same_addr | contained_addr) & (s >= 0.25), RULES[0]).when(exact & door, RULES[1])
        .when(exact & (d <= reach), RULES[2]).when((s >= 0.9) & (d <= 120), RULES[3])
        .when((s >= 0.82) & (d <= 60), RULES[4]).when(inside & (d <= 80), RULES[5])
    )
    return keep_value(pairs, "rule", rule).select(
        a("id").alias("a"), b("id").alias("b"), a("copies").alias("a_copies"), b("copies").alias("b_copies"), "category",
        F.floor(s * 1000 + 0.5).cast("long").alias("similarity_milli"), geo.js_round(d).alias("distance_m"),
        same_addr.alias("same_address"), "rule",
    )


def _equal_key_pairs(units: DataFrame, keys: list[str]) -> DataFrame:
    """(category, a_id, b_id) of the units that agree in all keys."""
    a, b = (units.select("category", *keys, F.col("id").alias(n)) for n in ("a_id", "b_id"))
    return skew_join(a, b, ["category", *keys]).where("a_id < b_id").select("category", "a_id", "b_id")


def contained_addresses(units: DataFrame, n: int = 6) -> DataFrame:
    """(category, short, long): distinct addresses of which one contains the other.

    A contained address shares every one of its n-grams with the longer one, so meeting on its rarest n-gram
    misses nothing; the rarest one keeps the meeting groups as small as the data allows.
    """
    addrs = units.select("category", "addr").where(F.length("addr") >= n).distinct()
    index = cut_lineage(addrs.select("category", "addr", F.explode(F.array_distinct(T.ngrams("addr", n))).alias("gram")))
    df = index.groupBy("category", "gram").agg(F.count(F.lit(1)).alias("df"))
    rare = skew_join(index, df, ["category", "gram"]).groupBy("category", "addr").agg(F.min(F.struct("df", "gram")).alias("m"))
    probe = rare.select("category", F.col("addr").alias("short"), F.col("m.gram").alias("gram"))
    met = skew_join(index.withColumnRenamed("addr", "long"), probe, ["category", "gram"])
    return met.where((F.length("long") > F.length("short")) & F.col("long").contains(F.col("short"))).select("category", "short", "long")


def similar_name_keys(side: int, name: str = "nm", loss: float = 0.18, gram: int = 4) -> Column:
    """Text keys that two names share when their edit similarity is at least 1 - loss, or one contains the other.

    Edits: a name of n letters has n bigrams (a start mark stands before the first letter). With at most
    t = floor(loss · L) edits, L the longer length, at most 2t bigrams of either name are not in the other, so in any
    fixed order the first 2t + 1 different bigrams of the two names share one. The order is by hash, and t is taken at the
    longest partner that a name can have, so a name has about 0.44 n keys. Containment: a contained name of `gram`
    or more letters starts with a piece that is one of the longer name's pieces; the two sides of a pair write the
    two parts (A, B) the other way round.
    """
    n = F.length(name)
    none = F.array().cast("array<string>")
    marked = F.concat(F.lit("^"), F.col(name))
    bigrams = F.when(n > 0, F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(marked, i, 2))).otherwise(none)
    edits = F.floor(F.floor(n / F.lit(1 - loss) + 1e-9) * F.lit(loss) + 1e-9).cast("int")
    ordered = F.array_sort(F.transform(F.array_distinct(bigrams), lambda g: F.struct(F.xxhash64(g).alias("h"), g.alias("g"))))
    edit_keys = F.transform(F.slice(ordered, F.lit(1), 2 * edits + 1), lambda x: F.concat(F.lit("e:"), x["g"]))
    pieces = F.transform(T.ngrams(name, gram), lambda g: F.concat(F.lit("g:"), g))
    start = F.when(n >= gram, F.array(F.concat(F.lit("g:"), F.substring(name, 1, gram)))).otherwise(none)
    if gram == 1:  # an empty name is contained in every name
        pieces, start = F.concat(pieces, F.array(F.lit("g:"))), F.concat(start, F.when(n == 0, F.array(F.lit("g:"))).otherwise(none))
    first, second = ("A", "B") if side == 0 else ("B", "A")
    keys = F.concat(edit_keys, F.transform(pieces, lambda k: F.concat(F.lit(first), k)), F.transform(start, lambda k: F.concat(F.lit(second), k)))
    return F.when((n > 0) | F.lit(gram == 1), keys).otherwise(none)


SUBSETS = ((3, 4), (2, 9), (1, 1_000_000))  # bigrams of a key, and the most edits that it is used up to


def rare_name_keys(names: DataFrame, name: str = "nm", loss: float = 0.18, gram: int = 4) -> DataFrame:
    """(name, side_0, side_1): long keys that two of the names share on their two sides when their edit similarity is at
    least 1 - loss, or one contains the other. Unlike those of similar_name_keys they follow what is rare among the names.

    Edits: a pair has at most t = floor(loss · L) edits, L the longer length. At most 2t numbered bigrams of either name are
    not in the other, so in the order rarest first, the first 2t + j of both share j, and every j of a name's are one key: a
    part that all names have in common makes no meetings. j is 3 for up to 4 edits, and less for long names, which would
    have too many keys. As the longer one a name has the keys of its own t, as the shorter one those of each t that its
    partners can have; the two sides write these parts (A, B) the other way round. Containment: a contained name meets on
    its rarest piece of `gram` letters.
    """
    n = F.length(name)
    marked = F.concat(F.lit("^"), F.col(name))
    bigrams = F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(marked, i, 2))
    rows = names.select(name).distinct().where(n > 0).withColumn("_b", bigrams)
    numbered = F.transform("_b", lambda g, i: F.concat(
        F.lit("e:"), g, F.lit("#"), F.size(F.filter(F.slice("_b", F.lit(1), i + 1), lambda x: x == g)).cast("string")))
    grams = F.transform(F.array_distinct(T.ngrams(name, gram)), lambda g: F.concat(F.lit("g:"), g))
    pieces = cut_lineage(rows.select(name, F.explode(F.concat(numbered, grams)).alias("piece")))
    often = pieces.groupBy("piece").agg(F.count(F.lit(1)).alias("often"))
    ranked = skew_join(pieces, often, ["piece"]).groupBy(name).agg(F.array_sort(F.collect_list(F.struct("often", "piece"))).alias("_l"))

    def of(kind):
        return F.transform(F.filter("_l", lambda x: x["piece"].startswith(kind)), lambda x: F.xxhash64(x["piece"]))

    def edits(length):
        return F.floor(length * F.lit(loss) + 1e-9).cast("int")

    def subsets(t, size):
        first = F.slice("_e", F.lit(1), 2 * t + size)
        after = lambda k: F.slice(first, k + 2, F.size(first))
        if size == 1:
            return F.transform(first, lambda x: F.xxhash64(t, x))
        if size == 2:
            return F.flatten(F.transform(first, lambda x, i: F.transform(after(i), lambda y: F.xxhash64(t, x, y))))
        return F.flatten(F.transform(first, lambda x, i: F.flatten(F.transform(
            after(i), lambda y, k: F.transform(after(i + k + 1), lambda z: F.xxhash64(t, x, y, z))))))

    def banded(ts, size, least, most):
        return F.flatten(F.transform(F.filter(ts, lambda t: t.between(least, most)), lambda t: subsets(t, size)))

    def keys(ts):
        least, parts = 0, []
        for size, most in SUBSETS:
            parts.append(banded(ts, size, least, most))
            least = most + 1
        # names of fewer than three letters allow no edit: all their bigrams are one key
        return F.when(F.size("_e") < 3, F.array(F.xxhash64(F.col("_e").cast("string")))).otherwise(F.concat(*parts))

    far = F.floor(n / F.lit(1 - loss) + 1e-9)
    ranked = ranked.select(name, of("e:").alias("_e"), of("g:").alias("_g"), edits(n).alias("_t"), edits(far).alias("_far"))
    ranked = ranked.select(name, "_g", keys(F.array("_t")).alias("_own"), keys(F.sequence("_t", "_far")).alias("_any"))
    mark = lambda a, part: F.transform(a, lambda g: F.xxhash64(F.lit(part), g))
    rarest = F.slice("_g", 1, 1)
    sides = [F.array_distinct(F.concat(mark("_own", p), mark("_any", q), mark("_g", "in" + p), mark(rarest, "in" + q))) for p, q in ("AB", "BA")]
    return cut_lineage(ranked).select(name, sides[0].alias("side_0"), sides[1].alias("side_1"))


def shared_letter_keys(units: DataFrame, share: float = 0.25) -> DataFrame:
    """(nm, keys): letters of which two names have one in common when their edit similarity is at least `share`.

    Such names share at least ceil(share · n) letters of a name of n letters (repeats numbered), so in any fixed order
    the first n - ceil(share · n) + 1 letters of both hold a common one. The order is rarest first over all names, which
    leaves out the letters that most names end with.
    """
    names = units.select("nm").distinct()
    n = F.length("nm")
    numbered = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(
        F.substring(F.col("nm"), i, 1), F.lit("#"),
        F.size(F.split(F.substring(F.col("nm"), F.lit(1), i), F.concat(F.lit("\\Q"), F.substring(F.col("nm"), i, 1), F.lit("\\E")))).cast("string")))
    letters = cut_lineage(names.select("nm", F.explode(F.when(n > 0, numbered).otherwise(F.array(F.lit("")))).alias("letter")))
    often = letters.groupBy("letter").agg(F.count(F.lit(1)).alias("often"))
    ranked = skew_join(letters, often, ["letter"]).groupBy("nm").agg(F.array_sort(F.collect_list(F.struct("often", "letter"))).alias("l"))
    first = n - F.ceil(n * share - 1e-9) + 1
    return cut_lineage(ranked.select("nm", F.transform(F.slice("l", F.lit(1), first.cast("int")), lambda x: x["letter"]).alias("keys")))


def _address_spans(units: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(spans, met): pairs of addresses whose units all meet, and the id pairs of units that met on a letter instead.

    spans(category, short, long): a crowd (over CROWD units at one address) meets on letters only where that makes fewer
    meetings than its pairs; names that nearly all share their letters would meet once for each of them.
    """
    at = units.where("addr <> ''").select("category", "addr", "id", "nm")
    count = cut_lineage(at.groupBy("category", "addr").agg(F.count(F.lit(1)).alias("n")))
    crowds = count.where(F.col("n") > CROWD)
    spans = contained_addresses(units).unionByName(count.where("n > 1").select("category", F.col("addr").alias("short"), F.col("addr").alias("long")))
    spans = cut_lineage(spans)
    if crowds.isEmpty():
        return spans, None
    crowded = at.join(crowds.select("category", "addr"), ["category", "addr"], "left_semi")
    keys = crowded.join(shared_letter_keys(crowded), "nm").select("category", "addr", F.explode("keys").alias("key"))
    load = keys.groupBy("category", "addr", "key").agg(F.count(F.lit(1)).alias("m")).groupBy("category", "addr").agg(F.sum(F.col("m") * F.col("m")).alias("load"))
    apart = cut_lineage(load.join(crowds, ["category", "addr"]).where(F.col("load") < F.col("n") * F.col("n")).select("category", "addr", F.lit(True).alias("full")))
    if apart.isEmpty():
        return spans, None
    for side in ("short", "long"):
        spans = spans.join(apart.select("category", F.col("addr").alias(side), F.col("full").alias("full_" + side)), ["category", side], "left")
    spans = cut_lineage(spans.select("category", "short", "long", F.coalesce("full_short", "full_long", F.lit(False)).alias("full")))
    full = spans.where("full").drop("full")
    ends = full.select("category", F.explode(F.array("short", "long")).alias("addr")).distinct()
    crowded = at.join(ends, ["category", "addr"], "left_semi")
    keyed = crowded.join(shared_letter_keys(crowded), "nm").withColumn("key", F.explode("keys"))
    return spans.where("NOT full").drop("full"), _units_at(keyed, full, ["key"]).distinct()


def _units_at(at: DataFrame, spans: DataFrame, more: list[str]) -> DataFrame:
    short = at.select("category", F.col("addr").alias("short"), F.col("id").alias("x"), *more)
    long = at.select("category", F.col("addr").alias("long"), F.col("id").alias("y"), *more)
    met = skew_join(long, skew_join(short, spans, ["category", "short"]), ["category", "long", *more])
    met = met.where((F.col("short") != F.col("long")) | (F.col("x") < F.col("y")))
    return met.select("category", F.least("x", "y").alias("a_id"), F.greatest("x", "y").alias("b_id"))


def _side(units: DataFrame, prefix: str) -> DataFrame:
    return units.select("category", *[F.col(c).alias(prefix + c) for c in units.columns if c != "category"])


def _in_order(pairs: DataFrame, columns: list[str]) -> DataFrame:
    """x_*, y_* to a_*, b_* with a_id < b_id."""
    swap = F.col("x_id") > F.col("y_id")
    sides = [F.when(swap, F.col(q + c)).otherwise(F.col(p + c)).alias(n + c) for n, p, q in (("a_", "x_", "y_"), ("b_", "y_", "x_")) for c in columns]
    return pairs.select("category", *sides)


def _span_pairs(units: DataFrame, spans: DataFrame, heads: bool = False) -> DataFrame:
    """Pairs of units, with their content, at the two addresses of each span; none is shuffled after it is met.

    With `heads` only the smallest id of each address meets the others of its own and the smallest of the other one.
    A unit column `label` keeps pairs of equal labels out.
    """
    columns = [c for c in units.columns if c != "category"]
    content = [c for c in columns if c != "label"]
    at = units.where("addr <> ''")
    lead = at.groupBy("category", "addr").agg(F.min("id").alias("id")).select("category", "id") if heads else None
    first = at.join(lead, ["category", "id"], "left_semi").select(*units.columns) if heads else at
    other = F.lit(True) if "label" not in columns else F.col("x_label") != F.col("y_label")
    own = spans.where("short = long").select("category", F.col("short").alias("x_addr"))
    own = skew_join(_side(at, "y_").withColumn("x_addr", F.col("y_addr")), skew_join(_side(first, "x_"), own, ["category", "x_addr"], "left_semi"), ["category", "x_addr"])
    own = own.where((F.col("x_id") < F.col("y_id")) & other)
    own = own.select("category", *[F.col(p + c).alias(n + c) for n, p in (("a_", "x_"), ("b_", "y_")) for c in content])
    apart = spans.where("short <> long").select("category", F.col("short").alias("x_addr"), F.col("long").alias("y_addr"))
    met = skew_join(_side(first, "y_"), skew_join(_side(first, "x_"), apart, ["category", "x_addr"]), ["category", "y_addr"]).where(other)
    return own.unionByName(_in_order(met, content))


def _with_content(met: DataFrame, units: DataFrame) -> DataFrame:
    for side in ("a_", "b_"):
        met = met.join(_side(units, side).drop("category"), side + "id")
    return met


def _other_evidence(units: DataFrame, met: DataFrame | None) -> DataFrame:
    """Evidence between units that no span joins: rules two to six, the copies of a unit, and pairs that met on a letter."""
    slim = units.select("id", "category", "nm", "latitude", "longitude")
    ids = [
        _equal_key_pairs(units.where("door <> ''"), ["nm", "door"]),
        near_self_pairs(slim, 250.0, ["category", "nm"], unknown="zero", ids_only=True).drop("nm"),
        near_self_pairs(slim, 120.0, ["category"], unknown="zero", keyed_names=rare_name_keys, ids_only=True),
        units.where("copies > 1").select("category", F.col("id").alias("a_id"), F.col("id").alias("b_id")),
    ]
    every = ids[0]
    for more in ids[1:]:
        every = every.unionByName(more)
    found = _evidence(_with_content(every.distinct(), units)).where((F.col("rule") != RULES[0]) | (F.col("a") == F.col("b")))
    return found if met is None else found.unionByName(_evidence(_with_content(met, units)).where(F.col("rule") == RULES[0]))


def evidence_parts(units: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(spans, other) that duplicate_edges and duplicate_links both start from, stored for a caller that needs both."""
    spans, met = _address_spans(units)
    return spans, cut_lineage(_other_evidence(units, met))


def _parts(units: DataFrame) -> tuple[DataFrame, DataFrame]:
    spans, met = _address_spans(units)
    return spans, _other_evidence(units, met)


def duplicate_edges(units: DataFrame, parts: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """Evidence between units. A row with a = b says that the copies of that unit are duplicates of each other.

    The first rule is that of related addresses: its pairs are met with their content and judged where they meet, so they
    are never shuffled, however many one address has. The other five are reached through three meeting keys; there only
    ids meet, and each pair then gets its two units' content once. With `parts` from evidence_parts nothing runs before
    the result is read.
    """
    spans, other = parts or _parts(units)
    by_address = _evidence(_span_pairs(units, spans)).where(F.col("rule") == RULES[0])
    return by_address.unionByName(other)


def duplicate_links(units: DataFrame, parts: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(a, b): enough of duplicate_edges to tell the groups, and all rows with a = b.

    The smallest id of an address meets the others first; what that and the other rules group needs no further look, so
    of all other pairs at related addresses only those of different groups are judged.
    """
    spans, other = parts or _parts(units)
    stars = _evidence(_span_pairs(units, spans, heads=True)).where(F.col("rule") == RULES[0])
    links = cut_lineage(stars.select("a", "b").unionByName(other.select("a", "b")))
    label = components(links.where("a <> b")).select("id", F.col("component").alias("found"))
    told = cut_lineage(units.join(label, "id", "left").select(*units.columns, F.coalesce("found", "id").alias("label")))
    rest = _evidence(_span_pairs(told, spans)).where(F.col("rule") == RULES[0])
    return links.unionByName(rest.select("a", "b"))


def duplicate_groups(units: DataFrame, members: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, group_id) of every place in a group of two or more; the group id is its smallest place id."""
    comp = components(edges.where("a <> b").select("a", "b"))
    own = edges.where("a = b").select(F.col("a").alias("id"))
    grouped = comp.unionByName(
        own.join(comp.select("id"), "id", "left_anti").select("id", F.col("id").alias("component")))
    content = [c for c in members.columns if c != "id"]
    # copies share all content, hence all evidence: every copy joins the group of its unit
    heads = units.join(grouped, "id").select(*content, "component")
    same = [members[c].eqNullSafe(heads[c]) for c in content]
    return members.join(heads, same).select(members["id"], F.col("component").alias("group_id"))


def canonical_choice(rows: DataFrame) -> DataFrame:
    """Per group: most complete, then newest, then smallest id."""
    best = F.min_by(F.col("id"), F.struct((-F.col("completeness")).alias("c"), (-F.col("updated_at")).alias("u"), F.col("id").alias("i")))
    return rows.groupBy("group_id").agg(best.alias("canonical_id"), F.count(F.lit(1)).alias("members"))


def _longest(field: str, ignored=()) -> Column:
    v = T.strip(field)
    ok = v != ""
    for i in ignored:
        ok = ok & (v != i)
    order = F.struct((-F.length(v)).alias("n"), (-F.col("updated_at")).alias("u"), F.col("id").alias("i"))
    return F.min_by(v, F.when(ok, order))


def merge_groups(rows: DataFrame, canon: DataFrame) -> DataFrame:
    """Survivorship: one merged record per group. Every pick is a mergeable aggregate, no group is collected."""
    r = rows.join(canon.select("group_id", "canonical_id"), "group_id")
    own = F.col("id") == F.col("canonical_id")
    has_point = F.coalesce((F.col("latitude") != 0) & (F.col("longitude") != 0), F.lit(False))
    by_age = F.struct((-F.col("updated_at")).alias("u"), F.col("id").alias("i"))
    point = F.struct("latitude", "longitude")
    name_order = F.struct((-F.length("name")).alias("n"), (-F.col("updated_at")).alias("u"), F.col("id").alias("i"))
    agg = r.groupBy("group_id", "canonical_id").agg(
        F.count(F.lit(1)).alias("members"), F.min_by("name", name_order).alias("name"),
        F.max(F.when(own, F.col("category"))).alias("category"),
        F.max(F.when(own, T.text("address"))).alias("own_address"), _longest("address").alias("long_address"),
        F.max(F.when(own, F.col("latitude"))).alias("own_lat"), F.max(F.when(own, F.col("longitude"))).alias("own_lon"),
        F.max(F.when(own, has_point)).alias("own_point"),
        F.min_by(point, F.when(has_point, by_age)).alias("first_point"),
        _longest("hours", (dims.ONSITE_HOURS,)).alias("long_hours"), F.max(F.when(own, T.text("hours"))).alias("own_hours"),
        _longest("description").alias("long_desc"), F.max(F.when(own, T.text("description"))).alias("own_desc"),
    )
    use_own = F.col("own_point") | F.col("first_point").isNull()
    return agg.select(
        "group_id", F.col("canonical_id").alias("id"), "members", "name", "category",
        F.when(F.col("own_address") != "", F.col("own_address")).otherwise(F.coalesce("long_address", F.lit(""))).alias("address"),
        F.when(use_own, F.col("own_lat")).otherwise(F.col("first_point.latitude")).alias("latitude"),
        F.when(use_own, F.col("own_lon")).otherwise(F.col("first_point.longitude")).alias("longitude"),
        F.coalesce("long_hours", "own_hours").alias("hours"), F.coalesce("long_desc", "own_desc").alias("description"),
    )


def merge_photos(group_photos: DataFrame) -> DataFrame:
    """Re-parent photos to the canonical place.

    Input: group_id, canonical_id, place_id, member_updated_at, photo_id, url, sort_order. The canonical's own
    photos stay as they are; the photos of the others are appended in member order (newest first), each url once.
    """
    own = F.col("place_id") == F.col("canonical_id")
    p = group_photos.withColumn("own", own)
    order = ["place_rank", "place_id", "sort_order", "photo_id"]
    p = p.withColumn("place_rank", F.when(own, F.lit(None).cast("long")).otherwise(-F.col("member_updated_at")))
    mine = p.where("own")
    taken = mine.select("group_id", "url").distinct()
    firsts = p.where("not own").join(taken, ["group_id", "url"], "left_anti").groupBy("group_id", "canonical_id", "url").agg(
        F.min(F.struct(*order)).alias("m")).select("group_id", "canonical_id", "url", "m.*")
    base = mine.groupBy("group_id").agg(F.count(F.lit(1)).alias("base"))
    moved = rank_within(firsts, ["group_id"], order, "n").join(base, "group_id", "left")
    kept = mine.select("group_id", "canonical_id", "photo_id", "url", F.col("sort_order").cast("long").alias("sort_order"), F.lit(False).alias("moved"))
    return kept.unionByName(moved.select(
        "group_id", "canonical_id", "photo_id", "url",
        (F.coalesce("base", F.lit(0)) + F.col("n") - 1).cast("long").alias("sort_order"), F.lit(True).alias("moved")))


def exact_duplicates(places: DataFrame) -> DataFrame:
    """Later rows with an already seen category|name|address key, with the name and id of the first row."""
    comparable = F.when(F.col("category") == "自然", F.lower(T.strip("name"))).otherwise(T.normalize_name("name"))
    keyed = places.select(
        "id", "name", "category", "address", comparable.alias("cn"), T.normalize_address("address").alias("ca"))
    first = keyed.groupBy("category", "cn", "ca").agg(F.min(F.struct("name", "id")).alias("f"))
    first = first.select("category", "cn", "ca", F.col("f.name").alias("duplicate_of"), F.col("f.id").alias("original_id"))
    return skew_join(keyed, first, ["category", "cn", "ca"]).where("id <> original_id").select(
        "id", "name", "category", "address", "duplicate_of", "original_id")


def grid_conflicts(rows: DataFrame, same: list[str], radius: float, key: str = "nm", contained: bool = True) -> DataFrame:
    """(earlier, later) edges of rows(id, ord, same.., key) nearer than the radius, with contained keys if asked."""
    fine = (lambda side: similar_name_keys(side, key, 0.0, 1)) if contained else None
    pairs = near_self_pairs(rows, radius, same, fine=fine)
    if contained:
        pairs = pairs.where(T.contains_either(F.col("a_" + key), F.col("b_" + key)))
    flip = F.struct("b_ord", "b_id") < F.struct("a_ord", "a_id")
    return pairs.where(F.col("distance") < radius).select(
        F.when(flip, F.col("b_id")).otherwise(F.col("a_id")).alias("earlier"),
        F.when(flip, F.col("a_id")).otherwise(F.col("b_id")).alias("later"))
