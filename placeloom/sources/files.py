"""Archive readers and report/backup writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from placeloom.functions import text as T
from placeloom.operators.scale import rank_within

CRAWL_SCHEMA = (
    "place STRUCT<id: STRING, name: STRING, category: STRING, references: ARRAY<STRING>>, phase STRING, channel STRING, query STRING, "
    "requestedUrl STRING, resultUrl STRING, success BOOLEAN, statusCode INT, metadata MAP<STRING, STRING>, "
    "links MAP<STRING, ARRAY<STRUCT<href: STRING, text: STRING, title: STRING, base_domain: STRING>>>, "
    "media STRUCT<images: ARRAY<STRUCT<src: STRING, desc: STRING>>>, fileLengths MAP<STRING, BIGINT>"
)
VISION_SCHEMA = (
    "path STRING, classifications ARRAY<STRUCT<label: STRING, confidence: DOUBLE>>, "
    "texts ARRAY<STRUCT<text: STRING, confidence: DOUBLE, x: DOUBLE, y: DOUBLE, width: DOUBLE, height: DOUBLE>>, "
    "faces ARRAY<STRUCT<area: DOUBLE>>, humans ARRAY<STRUCT<area: DOUBLE>>, faceCount INT, humanCount INT"
)


def crawl_archive(spark: SparkSession, folder: str, schema: str = CRAWL_SCHEMA, glob: str = "*.json", multi_line: bool = True) -> DataFrame:
    """Every JSON record below a folder, with the path it came from."""
    df = spark.read.schema(schema).option("multiLine", multi_line).option("recursiveFileLookup", True).option("pathGlobFilter", glob).json(folder)
    return df.withColumn("archive_path", F.col("_metadata.file_path"))


def vision_records(spark: SparkSession, path: str) -> DataFrame:
    """One row per image path with the labels as a map."""
    v = spark.read.schema(VISION_SCHEMA).json(path)
    return v.withColumn("labels", F.map_from_entries("classifications")).drop("classifications")


def audit_shards(spark: SparkSession, paths: list[str], result_schema: str, multi_line: bool = True) -> DataFrame:
    """Union of the result lists of several shard files, one row per result; a file is one record, or one record a line."""
    df = spark.read.schema(f"results ARRAY<STRUCT<{result_schema}>>").option("multiLine", multi_line).json(paths)
    return df.select(F.explode("results").alias("r")).select("r.*")


def inventory(spark: SparkSession, folder: str) -> DataFrame:
    """(path, bytes, sha256, top) of every file below a folder; each file is read and hashed by one task."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    root = folder.rstrip("/").replace("file:", "")
    rel = F.regexp_replace(F.regexp_replace("path", "^file:/+", "/"), f"^.*\\Q{root}\\E/", "")
    return df.select(rel.alias("path"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256")).withColumn(
        "top", F.substring_index("path", "/", 1))


def inventory_totals(files: DataFrame) -> DataFrame:
    return files.groupBy("top").agg(F.count(F.lit(1)).alias("files"), F.sum("bytes").alias("bytes"))


def nest_photos(places: DataFrame, photos: DataFrame, chunk: int = 10_000) -> DataFrame:
    """Places with their photo urls as ordered arrays of `chunk` urls at most, numbered by `part`.

    A place has one row per part, nearly always the single part 0; so a list of any length is published and no
    task gathers more than a chunk.
    """
    pos = rank_within(photos.select("place_id", "photo_id", "url", "sort_order"), ["place_id"], ["sort_order", "photo_id"], "pos")
    part = F.floor((F.col("pos") - 1) / chunk).cast("int")
    arr = pos.groupBy(F.col("place_id").alias("id"), part.alias("part")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "url"))), lambda p: p["url"]).alias("photos"))
    joined = places.join(arr, "id", "left")
    return joined.withColumn("photos", F.coalesce("photos", F.array().cast("array<string>"))).withColumn("part", F.coalesce("part", F.lit(0)))


def ordered_photos(places: DataFrame, photos: DataFrame) -> DataFrame:
    """Flat form of the same scan: one row per photo with its position; places without photos keep one row."""
    pos = rank_within(photos.select("place_id", "photo_id", "url", "sort_order"), ["place_id"], ["sort_order", "photo_id"], "pos")
    return places.join(pos.withColumnRenamed("place_id", "id"), "id", "left")


def epoch_seconds(c):
    """Epoch seconds of a value that may be seconds or milliseconds."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(F.abs(c) >= 100_000_000_000, F.floor(c / 1000)).otherwise(c).cast("bigint")


def publish_docs(nested: DataFrame) -> DataFrame:
    """The published fields and the part of the photo list; the update time becomes an ISO date."""
    day = F.date_format(F.timestamp_seconds(epoch_seconds("updated_at")), "yyyy-MM-dd")
    return nested.select(
        "id", "name", "category", "latitude", "longitude", "address", "hours", "description", "part", "photos", day.alias("updated_at"))


BACKUP_COLUMNS = ["id", "name", "category", "latitude", "longitude", "address", "hours", "description", "photos", "updated_at", "part"]


def backup_rows(docs: DataFrame) -> DataFrame:
    return docs.withColumn("photos", F.array_join("photos", ";")).select(*BACKUP_COLUMNS)


def write_backup(docs: DataFrame, path: str) -> None:
    """CSV folder in the fixed column order, newest first, quoted where needed."""
    rows = backup_rows(docs).orderBy(F.desc("updated_at"), F.asc("id"))
    rows.write.mode("overwrite").option("header", True).option("escape", '"').option("emptyValue", "").csv(path)


def write_report(metrics: DataFrame, path: str, run_id: str) -> None:
    """Append one run's metric rows under its own partition."""
    metrics.withColumn("run_id", F.lit(run_id)).write.mode("append").partitionBy("run_id").json(path)


def embedded_answer(pages: DataFrame, item_schema: str, html: str = "html") -> DataFrame:
    """Items of an API answer that was archived inside the <pre> of a page."""
    body = F.regexp_extract(T.text(html), r"(?s)<pre[^>]*>(.*?)</pre>", 1)
    entities = [("&lt;", "<"), ("&gt;", ">"), ("&quot;|&#34;", '"'), ("&#39;", "'"), ("&amp;", "&")]
    parsed = F.from_json(T.sub(body, *entities), f"data STRUCT<items: ARRAY<STRUCT<{item_schema}>>>")
    return pages.select("page_id", F.posexplode(parsed["data"]["items"]).alias("item_no", "item"))
