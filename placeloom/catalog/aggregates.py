"""Section D: aggregations."""

from __future__ import annotations

from pyspark.sql import functions as F

from placeloom import dims
from placeloom.catalog import duck as D
from placeloom.catalog.joins import EDGES, scored
from placeloom.catalog.registry import query
from placeloom.functions import geo, rules, text as T
from placeloom.operators import audit as A, duplicates as DUP, gallery as G, matching as M, sync
from placeloom.operators.scale import skew_join
from placeloom.session import cut_lineage

ISSUES = "list_filter([" + ", ".join(f"CASE WHEN {c} THEN '{n}' END" for n, c in D.issue_list()) + "], lambda x: x IS NOT NULL)"


@query("d1_issue_counts", uses="places_v", sql=f"""
    SELECT category, issue, count(*) AS findings FROM (SELECT category, unnest({ISSUES}) AS issue FROM places_v) GROUP BY 1, 2""")
def d1(t):
    return A.issue_counts(A.findings(t("places_v")))


@query("d1_issue_samples", uses="places_v", sql=f"""
    SELECT name, id, issue FROM (SELECT name, id, unnest({ISSUES}) AS issue FROM places_v) ORDER BY name, id, issue LIMIT 100""")
def d1s(t):
    """The report's first hundred samples in name order."""
    return A.findings(t("places_v")).select("name", "id", "issue").orderBy("name", "id", "issue").limit(100)


@query("d2_status_counts", uses="places_v", sql="""
    SELECT count(*) FILTER (status <> 'open') AS completed, count(*) FILTER (status = 'open') AS remaining,
      count(*) FILTER (status = 'verified_poi') AS verified_poi, count(*) FILTER (status = 'unverified') AS unverified
    FROM (SELECT CASE k % 4 WHEN 0 THEN 'open' WHEN 1 THEN 'unverified' ELSE 'verified_poi' END AS status FROM places_v)""")
def d2(t):
    s = t("places_v").select(F.when(F.col("k") % 4 == 0, "open").when(F.col("k") % 4 == 1, "unverified").otherwise("verified_poi").alias("status"))
    return A.status_counts(s, ["verified_poi", "unverified"])


@query("d3_field_coverage", uses="places_v photos_v", sql="""
    SELECT category, city, count(*) AS places, count(*) FILTER (hours <> '') AS with_hours, count(*) FILTER (description <> '') AS with_description, count(*) FILTER (n > 0) AS with_photos
    FROM (SELECT p.category, p.hours, p.description, coalesce(f.n, 0) AS n, CASE WHEN address LIKE '上海市%' THEN '上海' WHEN address LIKE '苏州市%' OR address LIKE '苏州高新区%' THEN '苏州'
       WHEN address LIKE '嘉兴市%' THEN '嘉兴' WHEN address LIKE '无锡市%' THEN '无锡' ELSE '' END AS city
      FROM places_v p LEFT JOIN (SELECT place_id, count(*) AS n FROM photos_v GROUP BY 1) f ON f.place_id = p.id) GROUP BY ROLLUP (category, city)""")
def d3(t):
    return A.field_coverage(DUP.with_photo_count(t("places_v"), t("photos_v")))


DUP_KEY = f"CASE WHEN category = '自然' THEN lower(trim(name)) ELSE {D.name_quality('name')} END"


@query("d4_exact_duplicates", uses="places_v", sql=f"""
    SELECT id, name, category, address, duplicate_of, original_id FROM (SELECT *, first_value(name) OVER w AS duplicate_of, first_value(id) OVER w AS original_id
      FROM (SELECT *, {DUP_KEY} AS cn, {D.addr_quality('address')} AS ca FROM places_v) WINDOW w AS (PARTITION BY category, cn, ca ORDER BY name, id)) WHERE id <> original_id""")
def d4(t):
    return DUP.exact_duplicates(t("places_v"))


@query("d5_quota_violations", uses="places_v photos_v", sql="""
    SELECT p.id, p.category, count(*) AS photo_count FROM places_v p JOIN photos_v f ON f.place_id = p.id GROUP BY 1, 2 HAVING count(*) > CASE WHEN p.category = '自然' THEN 10 ELSE 5 END""")
def d5(t):
    rows = DUP.with_photo_count(t("places_v"), t("photos_v"))
    return rows.where(F.col("photo_count") > F.when(F.col("category") == "自然", 10).otherwise(5)).select("id", "category", "photo_count")


@query("d6_cross_place_content", uses="photos_v", sql="""
    SELECT photo_id, place_id, digest FROM photos_v WHERE digest IN (SELECT digest FROM photos_v GROUP BY 1 HAVING count(DISTINCT place_id) > 1)""")
def d6(t):
    p = t("photos_v").select("photo_id", "place_id", "digest")
    return skew_join(p, G.cross_place_content(p), ["digest"], "left_semi")


GROUPS = f"""{EDGES},
    e AS (SELECT a, b FROM edges WHERE rule IS NOT NULL), bi AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
    reach AS (SELECT a AS id, a AS root FROM bi UNION SELECT bi.b, r.root FROM reach r JOIN bi ON bi.a = r.id),
    comp AS (SELECT id, min(root) AS group_id FROM reach GROUP BY 1),
    grp AS (SELECT x.id, c.group_id FROM x JOIN u ON x.category = u.category AND x.latitude = u.latitude AND x.longitude = u.longitude AND x.nm = u.nm AND x.addr = u.addr AND x.door = u.door AND x.kids = u.kids
       JOIN comp c ON c.id = u.id)"""


def groups(t):
    units, members = DUP.signatures(t("places_v"))
    edges = cut_lineage(DUP.duplicate_links(units))
    return DUP.duplicate_groups(units, members, edges)


@query("d7_duplicate_groups", uses="places_v", sql=f"WITH RECURSIVE_MARK {GROUPS} SELECT id, group_id FROM grp")
def d7(t):
    return groups(t)


RICH = f"""{GROUPS}, rich AS (SELECT p.*, g.group_id, CASE WHEN p.latitude <> 0 AND p.longitude <> 0 THEN 25 ELSE 0 END + least(length(p.address), 20)
      + CASE WHEN p.hours <> '' AND p.hours <> '以现场公示为准' THEN 10 ELSE 0 END + CASE WHEN p.description <> '' THEN 8 ELSE 0 END + least(coalesce(f.n, 0) * 3, 12) AS completeness
      FROM places_v p JOIN grp g ON g.id = p.id LEFT JOIN (SELECT place_id, count(*) AS n FROM photos_v GROUP BY 1) f ON f.place_id = p.id),
    canon AS (SELECT group_id, arg_min(id, (-completeness, -updated_at, id)) AS canonical_id, count(*) AS members FROM rich GROUP BY 1)"""


def rich(t):
    rows = DUP.with_photo_count(t("places_v"), t("photos_v")).withColumn("completeness", DUP.completeness())
    return cut_lineage(rows.join(groups(t), "id"))


@query("d8_canonical", uses="places_v photos_v", sql=f"WITH RECURSIVE_MARK {RICH} SELECT group_id, canonical_id, members FROM canon")
def d8(t):
    return DUP.canonical_choice(rich(t))


def _best(field, cond="TRUE"):
    return f"coalesce(arg_min({field}, (-length({field}), -updated_at, id)) FILTER ({field} <> '' AND {cond}), '')"


@query("d9_survivorship", uses="places_v photos_v", sql=f"""
    WITH RECURSIVE_MARK {RICH}, r AS (SELECT r.*, c.canonical_id FROM rich r JOIN canon c USING (group_id)),
    a AS (SELECT group_id, canonical_id AS id, count(*) AS members, arg_min(name, (-length(name), -updated_at, id)) AS name,
      max(category) FILTER (id = canonical_id) AS category, max(address) FILTER (id = canonical_id) AS oa, {_best('address')} AS la,
      max(latitude) FILTER (id = canonical_id) AS olat, max(longitude) FILTER (id = canonical_id) AS olon,
      arg_min(latitude, (-updated_at, id)) FILTER (latitude <> 0 AND longitude <> 0) AS flat, arg_min(longitude, (-updated_at, id)) FILTER (latitude <> 0 AND longitude <> 0) AS flon,
      {_best('hours', "hours <> '以现场公示为准'")} AS lh, max(hours) FILTER (id = canonical_id) AS oh, {_best('description')} AS ld FROM r GROUP BY 1, 2)
    SELECT group_id, id, members, name, category, CASE WHEN oa <> '' THEN oa ELSE la END AS address, CASE WHEN (olat <> 0 AND olon <> 0) OR flat IS NULL THEN olat ELSE flat END AS latitude,
      CASE WHEN (olat <> 0 AND olon <> 0) OR flon IS NULL THEN olon ELSE flon END AS longitude, CASE WHEN lh <> '' THEN lh ELSE oh END AS hours, ld AS description FROM a""")
def d9(t):
    rows = rich(t)
    return DUP.merge_groups(rows, DUP.canonical_choice(rows))


@query("d10_photo_reparenting", uses="places_v photos_v", sql=f"""
    WITH RECURSIVE_MARK {RICH}, m AS (SELECT r.id, r.group_id, r.updated_at, c.canonical_id FROM rich r JOIN canon c USING (group_id)),
    f AS (SELECT m.*, p.photo_id, p.url, p.sort_order FROM m JOIN photos_v p ON p.place_id = m.id),
    own AS (SELECT * FROM f WHERE id = canonical_id),
    mv AS (SELECT * FROM f WHERE id <> canonical_id AND NOT EXISTS (SELECT 1 FROM own o WHERE o.group_id = f.group_id AND o.url = f.url)
       QUALIFY row_number() OVER (PARTITION BY group_id, url ORDER BY -updated_at, id, sort_order, photo_id) = 1)
    SELECT group_id, canonical_id, photo_id, url, CAST(sort_order AS BIGINT) AS sort_order, FALSE AS moved FROM own
    UNION ALL SELECT group_id, canonical_id, photo_id, url, (SELECT count(*) FROM own o WHERE o.group_id = mv.group_id) - 1 + row_number() OVER (PARTITION BY group_id ORDER BY -updated_at, id, sort_order, photo_id), TRUE FROM mv""")
def d10(t):
    rows = rich(t)
    canon = DUP.canonical_choice(rows).select("group_id", "canonical_id")
    m = rows.select(F.col("id").alias("place_id"), "group_id", F.col("updated_at").alias("member_updated_at")).join(canon, "group_id")
    return DUP.merge_photos(t("photos_v").select("place_id", "photo_id", "url", "sort_order").join(m, "place_id"))


@query("d11_keep_one", uses="notes_v", sql="""
    SELECT 'newest' AS policy, place_id, note_id FROM notes_v QUALIFY row_number() OVER (PARTITION BY place_id ORDER BY published DESC, o) = 1
    UNION ALL SELECT 'first', place_id, note_id FROM notes_v QUALIFY row_number() OVER (PARTITION BY place_id ORDER BY o) = 1
    UNION ALL SELECT 'last', place_id, note_id FROM notes_v QUALIFY row_number() OVER (PARTITION BY place_id ORDER BY o DESC) = 1
    UNION ALL SELECT 'best', place_id, note_id FROM notes_v QUALIFY row_number() OVER (PARTITION BY place_id ORDER BY length(body) DESC, o) = 1""")
def d11(t):
    n = t("notes_v")
    out = None
    for policy, order in (("newest", [F.desc("published"), F.asc("o")]), ("first", [F.asc("o")]), ("last", [F.desc("o")]), ("best", [F.desc(F.length("body")), F.asc("o")])):
        part = M.newest_by_key(n, ["place_id"], order).select(F.lit(policy).alias("policy"), "place_id", "note_id")
        out = part if out is None else out.unionByName(part)
    return out


_GH = "sha256(concat_ws(chr(31), id, name, category, address, CAST(updated_at AS STRING), hours, description))"


@query("d12_guard_hash", uses="places_v", sql=f"""
    SELECT category, count(*) AS rows, CAST(sum(CAST('0x' || substr({_GH}, 1, 15) AS BIGINT)) AS HUGEINT) AS hash_a, CAST(sum(CAST('0x' || substr({_GH}, 16, 15) AS BIGINT)) AS HUGEINT) AS hash_b FROM places_v GROUP BY 1""")
def d12(t):
    return sync.guard_hash(t("places_v"), ["category"], ["id", "name", "category", "address", "updated_at", "hours", "description"])


@query("d13_reverse_references", sql="""
    WITH r AS (SELECT o_orderkey AS pg, 'p' || CAST(o_custkey AS STRING) AS place_id, CASE WHEN o_orderkey % 3 = 0
        THEN 'https://img01.sogoucdn.com/v2?t=1&url=https%3A%2F%2Fa.example.com%2F' || (o_orderkey % 200) || '.jpg' ELSE 'https://a.example.com/' || (o_orderkey % 200) || '.jpg' END AS url FROM orders WHERE o_orderkey % 11 <> 0)
    SELECT DISTINCT url, 'extracted' AS kind, place_id, pg AS page_id FROM r
    UNION SELECT DISTINCT 'https://a.example.com/' || (pg % 200) || '.jpg', 'proxy-original', place_id, pg FROM r WHERE pg % 3 = 0""")
def d13(t):
    from placeloom.operators.evidence import reverse_references

    n = (F.col("o_orderkey") % 200).cast("string")
    url = F.when(F.col("o_orderkey") % 11 == 0, "data:x").when(
        F.col("o_orderkey") % 3 == 0, F.concat(F.lit("https://img01.sogoucdn.com/v2?t=1&url=https%3A%2F%2Fa.example.com%2F"), n, F.lit(".jpg"))
    ).otherwise(F.concat(F.lit("https://a.example.com/"), n, F.lit(".jpg")))
    return reverse_references(t("orders").select(url.alias("url"), F.concat(F.lit("p"), F.col("o_custkey").cast("string")).alias("place_id"), F.col("o_orderkey").alias("page_id")))


@query("d14_option_lists", uses="visits_v aliases_v", sql="""
    WITH FLAT_MARK SELECT 'location' AS kind, province || '|' || city || '|' || district AS value, arg_max(concat_ws(' ', nullif(province, ''), nullif(city, ''), nullif(district, '')), (created_at, id)) AS label FROM flat GROUP BY 2
    UNION ALL SELECT 'visitor', visitor_code, arg_max(CASE WHEN visitor_name <> '' THEN visitor_name ELSE visitor_code END, (created_at, id)) FROM flat WHERE visitor_code <> '' GROUP BY 2""")
def d14(t):
    from placeloom.catalog.filters import visit_rows

    return A.visit_options(visit_rows(t))


@query("d15_removal_reasons", uses="photos_v", sql="""
    WITH r AS (SELECT place_id, CASE WHEN o % 10 = 0 THEN 'close_person' WHEN o % 7 = 0 THEN 'near_duplicate' WHEN o % 3 = 0 THEN 'over_limit' ELSE 'kept' END AS reason FROM photos_v)
    SELECT reason, count(*) AS photos, count(DISTINCT place_id) AS places FROM r GROUP BY 1""")
def d15(t):
    r = t("photos_v").select("place_id", F.when(F.col("o") % 10 == 0, "close_person").when(F.col("o") % 7 == 0, "near_duplicate").when(
        F.col("o") % 3 == 0, "over_limit").otherwise("kept").alias("reason"))
    return A.reason_counts(r)


@query("d16_evidence_coverage", uses="places_v notes_v", sql="""
    SELECT p.category, count(*) AS places, count(*) FILTER (n.place_id IS NOT NULL) AS with_evidence FROM places_v p
    LEFT JOIN (SELECT DISTINCT place_id FROM notes_v WHERE body LIKE '%热水%') n ON n.place_id = p.id GROUP BY 1""")
def d16(t):
    found = t("notes_v").where(F.col("body").contains("热水")).select(F.col("place_id").alias("id")).distinct()
    return A.evidence_coverage(t("places_v"), found)
