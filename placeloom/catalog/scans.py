"""Section A: scans, sources, sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from placeloom.catalog import duck as D
from placeloom.catalog.registry import query
from placeloom.functions import geo
from placeloom.operators import duplicates as DUP
from placeloom.session import scratch_path
from placeloom.sources import files

POS = "row_number() OVER (PARTITION BY place_id ORDER BY sort_order, photo_id)"


@query("a1_places_with_photos", uses="places_v photos_v", sql=f"""
    SELECT p.id, p.name, f.photo_id, f.url, f.pos FROM places_v p
    LEFT JOIN (SELECT place_id, photo_id, url, {POS} AS pos FROM photos_v) f ON f.place_id = p.id""")
def a1(t):
    return files.ordered_photos(t("places_v"), t("photos_v")).select("id", "name", "photo_id", "url", "pos")


@query("a2_under_quota", uses="places_v photos_v", sql="""
    SELECT p.id, p.category, count(f.photo_id) AS photo_count FROM places_v p LEFT JOIN photos_v f ON f.place_id = p.id
    GROUP BY 1, 2 HAVING count(f.photo_id) < CASE WHEN p.category = '自然' THEN 10 ELSE 5 END""")
def a2(t):
    quota = F.when(F.col("category") == "自然", 10).otherwise(5)
    return DUP.with_photo_count(t("places_v"), t("photos_v")).where(F.col("photo_count") < quota).select("id", "category", "photo_count")


@query("a3_city_page", uses="places_v", sql="""
    SELECT id, name, address FROM places_v WHERE (address LIKE '苏州市%' OR address LIKE '苏州高新区%') AND category = '图书馆'
    ORDER BY id LIMIT 50 OFFSET 10""")
def a3(t):
    rows = t("places_v").where((geo.city_of_address("address") == "苏州") & (F.col("category") == "图书馆"))
    return rows.select("id", "name", "address").orderBy("id").offset(10).limit(50)


def _write_archive(t):
    """The crawl archive of the pages table: nested JSON files below two folders."""
    root = scratch_path(t.spark, "archive")
    rec = t("pages").select(
        F.struct(F.concat(F.lit("p"), F.lpad(F.col("page_id").cast("string"), 8, "0")).alias("id")).alias("place"),
        F.when(F.col("page_id") % 2 == 0, "search").otherwise("sources").alias("phase"), F.lit("web").alias("channel"),
        F.col("url").alias("requestedUrl"), F.when(F.col("page_id") % 5 == 0, F.concat("url", F.lit("x"))).otherwise(F.col("url")).alias("resultUrl"),
        F.lit(True).alias("success"), F.create_map(F.lit("html"), F.length("html").cast("bigint")).alias("fileLengths"),
        (F.col("page_id") % 3).cast("int").alias("folder"))
    rec.write.partitionBy("folder").json(root)
    return root


@query("a4_crawl_archive", sql="""
    SELECT 'p' || lpad(CAST(page_id AS STRING), 8, '0') AS place_id, CASE WHEN page_id % 2 = 0 THEN 'search' ELSE 'sources' END AS phase,
           url AS requested_url, length(html) AS html_chars, CAST(page_id % 3 AS STRING) AS folder FROM pages""")
def a4(t):
    df = files.crawl_archive(t.spark, _write_archive(t), multi_line=False)
    folder = F.regexp_extract("archive_path", r"folder=(\d+)/", 1)
    return df.select(F.col("place.id").alias("place_id"), "phase", F.col("requestedUrl").alias("requested_url"),
                     F.col("fileLengths")["html"].alias("html_chars"), folder.alias("folder"))


def _vision(t):
    v = t("vision_v")
    names = ["bookshelf", "library", "outdoor", "food", "people", "document"]
    entries = [F.struct(F.lit(n).alias("label"), F.col(n).alias("confidence")) for n in names]
    entries += [F.struct(F.lit(n).alias("label"), F.col("desk_table").alias("confidence")) for n in ("desk", "table")]
    text = F.struct(
        F.col("txt").alias("text"), F.col("tconf").alias("confidence"), F.col("tx").alias("x"), F.col("ty").alias("y"),
        F.lit(0.2).alias("width"), F.lit(0.04).alias("height"))
    return v.select(
        F.col("photo_id").alias("path"), F.array(*entries).alias("classifications"), F.array(text).alias("texts"),
        F.array(F.struct(F.col("face_area").alias("area"))).alias("faces"), F.array(F.struct(F.col("human_area").alias("area"))).alias("humans"),
        F.col("face_count").alias("faceCount"), F.col("human_count").alias("humanCount"))


@query("a5_vision_records", uses="vision_v", sql="""
    SELECT photo_id, place_id, bookshelf, desk_table AS desk, txt AS first_text, face_count FROM vision_v""")
def a5(t):
    root = scratch_path(t.spark, "vision")
    _vision(t).write.json(root)
    v = files.vision_records(t.spark, root)
    j = t("photos_v").select("photo_id", "place_id").join(v, F.col("photo_id") == F.col("path"))
    return j.select("photo_id", "place_id", F.col("labels")["bookshelf"].alias("bookshelf"), F.col("labels")["desk"].alias("desk"),
                    F.col("texts")[0]["text"].alias("first_text"), F.col("faceCount").alias("face_count"))


@query("a6_audit_shards", uses="cands_v", sql="""
    SELECT place_id AS id, 'verified_' || kind AS status, cand_no FROM cands_v""")
def a6(t):
    root = scratch_path(t.spark, "shards")
    rows = t("cands_v").select(F.col("place_id").alias("id"), F.concat(F.lit("verified_"), "kind").alias("status"), "cand_no")
    # a shard file is a bounded chunk of results, never one list per place or per shard number
    chunk = F.pmod(F.xxhash64("id", "cand_no"), F.lit(64))
    lists = rows.withColumn("chunk", chunk).withColumn("part", F.spark_partition_id()).groupBy("chunk", "part").agg(
        F.collect_list(F.struct("id", "status", "cand_no")).alias("results"))
    lists.select(F.pmod("chunk", F.lit(3)).alias("shard"), "results").write.partitionBy("shard").json(root)
    return files.audit_shards(t.spark, [f"{root}/shard={i}" for i in range(3)], "id: STRING, status: STRING, cand_no: INT", multi_line=False)


DOCS = f"""
    SELECT p.id, p.name, p.category, p.latitude, p.longitude, p.address, p.hours, p.description,
           coalesce(f.photos, '') AS photos, coalesce(f.part, 0) AS part, strftime(make_timestamp(CAST(p.updated_at AS BIGINT) * 1000000), '%Y-%m-%d') AS updated_at
    FROM places_v p LEFT JOIN (SELECT place_id, part, string_agg(url, ';' ORDER BY sort_order, photo_id) AS photos FROM (
      SELECT *, (row_number() OVER (PARTITION BY place_id ORDER BY sort_order, photo_id) - 1) // 10000 AS part FROM photos_v) GROUP BY 1, 2) f ON f.place_id = p.id"""


@query("a7_csv_backup", uses="places_v photos_v", sql=DOCS)
def a7(t):
    """Writes the CSV backup and reads it back."""
    path = scratch_path(t.spark, "backup")
    files.write_backup(files.publish_docs(files.nest_photos(t("places_v"), t("photos_v"))), path)
    schema = ", ".join(f"{c} {'DOUBLE' if c in ('latitude', 'longitude') else 'INT' if c == 'part' else 'STRING'}" for c in files.BACKUP_COLUMNS)
    back = t.spark.read.schema(schema).option("header", True).option("escape", '"').option("multiLine", True).option(
        "mode", "FAILFAST").csv(path)
    return back.fillna("", [c for c in files.BACKUP_COLUMNS if c not in ("latitude", "longitude", "part")])


@query("a8_publish_docs", uses="places_v photos_v", sql=DOCS)
def a8(t):
    docs = files.publish_docs(files.nest_photos(t("places_v"), t("photos_v")))
    return files.backup_rows(docs)


@query("a9_archive_inventory", sql="""
    SELECT 'lang=' || lang AS top, count(*) AS documents FROM documents GROUP BY 1""")
def a9(t):
    """Inventory of a document archive on disk: files hashed, counted per top folder (documents counted from the lines)."""
    root = scratch_path(t.spark, "inventory")
    t("documents").select("doc_id", "lang").write.partitionBy("lang").json(root)
    inv = files.inventory(t.spark, root).where(F.col("path").contains("part-"))
    lines = t.spark.read.text(root, recursiveFileLookup=True).select(
        F.regexp_extract(F.col("_metadata.file_path"), r"(lang=[^/]+)/", 1).alias("top"))
    counts = lines.groupBy("top").agg(F.count(F.lit(1)).alias("documents"))
    return counts.join(files.inventory_totals(inv).where("files > 0 and bytes > 0").select("top"), "top")


@query("a10_state_summary", uses="notes_v", sql="""
    SELECT category, count(*) FILTER (status = 'verified') AS verified, count(*) FILTER (status = 'no_evidence') AS no_evidence,
           count(*) FILTER (status = 'error') AS errors, count(*) AS places, CAST(sum(images) AS BIGINT) AS images
    FROM (SELECT place_id, category, count(*) AS images, CASE WHEN max(length(body)) = 0 THEN 'error' WHEN count(*) FILTER (body LIKE '%今天去了附近%') = count(*)
          THEN 'no_evidence' ELSE 'verified' END AS status FROM notes_v GROUP BY 1, 2) GROUP BY 1""")
def a10(t):
    state = t("notes_v").groupBy("place_id", "category").agg(
        F.count(F.lit(1)).alias("images"), F.max(F.length("body")).alias("longest"),
        F.count_if(F.col("body").contains("今天去了附近")).alias("vague"))
    status = F.when(F.col("longest") == 0, "error").when(F.col("vague") == F.col("images"), "no_evidence").otherwise("verified")
    s = state.withColumn("status", status)
    return s.groupBy("category").agg(
        *[F.count_if(F.col("status") == v).alias(a) for v, a in (("verified", "verified"), ("no_evidence", "no_evidence"), ("error", "errors"))],
        F.count(F.lit(1)).alias("places"), F.sum("images").alias("images"))


@query("a11_run_report", uses="places_v", sql=f"""
    SELECT 'places' AS metric, category AS label, count(*) AS value, 'run-1' AS run_id FROM places_v GROUP BY 2
    UNION ALL SELECT 'without_hours', category, count(*) FILTER (hours = ''), 'run-1' FROM places_v GROUP BY 2""")
def a11(t):
    """Metric rows written as a run report and read back from the run's partition."""
    path = scratch_path(t.spark, "report")
    g = t("places_v").groupBy(F.col("category").alias("label")).agg(
        F.count(F.lit(1)).alias("places"), F.count_if(F.col("hours") == "").alias("without_hours"))
    files.write_report(g.unpivot(["label"], ["places", "without_hours"], "metric", "value"), path, "run-1")
    return t.spark.read.schema("metric STRING, label STRING, value BIGINT, run_id STRING").json(path)


@query("a12_embedded_answer", sql="""
    SELECT page_id, i AS item_no, 'n' || (page_id * 10 + i) || ' & "x"' AS title, page_id + i AS seats
    FROM pages, (SELECT unnest(range(0, 3)) AS i) r WHERE page_id % 2 = 0""")
def a12(t):
    """Pages that archive an API answer as escaped JSON; the answer is built from the page rows."""
    item = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.struct(
        F.concat(F.lit("n"), (F.col("page_id") * 10 + i).cast("string"), F.lit(' & "x"')).alias("title"), (F.col("page_id") + i).alias("seats")))
    js = F.to_json(F.struct(F.struct(item.alias("items")).alias("data")))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), ('"', "&quot;")):
        js = F.replace(js, F.lit(a), F.lit(b))
    pages = t("pages").select("page_id", F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("<html><pre>"), js, F.lit("</pre></html>"))).otherwise(F.col("html")).alias("html"))
    out = files.embedded_answer(pages, "title: STRING, seats: BIGINT")
    return out.select("page_id", "item_no", "item.title", "item.seats")
