"""Place-shaped tables derived from the test tables.

The SQL text below is the common subset of Spark SQL and DuckDB, so a registered query and its check SQL start
from the same rows. `@name` stands for a base table or for another derived table.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from placeloom.session import scratch_path

BASE = {
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
}


def pick(words: str, index: str) -> str:
    n = len(words.split(","))
    return f"split_part('{words}', ',', CAST(({index}) % {n} AS INT) + 1)"


def pad(expr: str, n: int = 8) -> str:
    return f"lpad(CAST({expr} AS STRING), {n}, '0')"


_PREFIX = pick("前程,新闸,岳阳,人民,太湖,共和,长海,瑞金,石门,殷行", "g")
_DISTRICT = pick("上海市浦东新区,上海市徐汇区,上海市杨浦区,上海市静安区,苏州市姑苏区,苏州高新区,嘉兴市南湖区,无锡市梁溪区", "g")
_ROAD = f"{_PREFIX} || {pick('路,公路,大道,街', 'g')}"
_WORD = "CASE g % 23 WHEN 5 THEN '大学' WHEN 7 THEN '政府路' WHEN 9 THEN '机关' WHEN 11 THEN '党群' WHEN 13 THEN '书房' ELSE '' END"
_KIND = (
    f"CASE g % 3 WHEN 0 THEN {pick('社区图书馆,街道图书馆（总馆）,社区少儿图书馆', 'm')} "
    f"WHEN 1 THEN {pick('社区长者食堂,社区食堂,长者食堂', 'm')} ELSE {pick('滨河公园,滨河公园（一期）,滨河绿地', 'm')} END"
)
_TAIL = (
    "CASE m WHEN 0 THEN n || '号' "
    "WHEN 1 THEN CASE g % 5 WHEN 0 THEN n || '号二楼' WHEN 1 THEN n || '弄20号' WHEN 2 THEN n || '号（近地铁站）' "
    "WHEN 3 THEN n || '-' || CAST(1 + g % 97 + 4 AS STRING) || '号' ELSE n || '号' END "
    "ELSE CASE g % 4 WHEN 1 THEN CAST(3 + g % 97 AS STRING) || '号' WHEN 2 THEN n || '号3幢' WHEN 3 THEN n || ' 号' ELSE n || '号' END END"
)
_LAT0 = "CASE WHEN g % 8 < 4 THEN 31.0e0 WHEN g % 8 < 6 THEN 31.2e0 WHEN g % 8 = 6 THEN 30.6e0 ELSE 31.4e0 END"
_LON0 = "CASE WHEN g % 8 < 4 THEN 121.0e0 WHEN g % 8 < 6 THEN 120.4e0 WHEN g % 8 = 6 THEN 120.6e0 ELSE 120.1e0 END"

DERIVED: dict[str, str] = {
    "places_v": f"""
        SELECT 'p' || {pad('k')} AS id, k, g,
               CASE WHEN k % 97 = 0 THEN '' WHEN k % 101 = 0 THEN '阅闲坊'
                    ELSE {_PREFIX} || {_WORD} || '第' || CAST(g AS STRING) || {_KIND} END AS name,
               CASE WHEN g % 29 = 0 THEN '书店' WHEN g % 3 = 0 THEN '图书馆' WHEN g % 3 = 1 THEN '食堂' ELSE '自然' END AS category,
               CASE WHEN k % 41 = 0 THEN '' WHEN k % 37 = 0 THEN {_DISTRICT} || '金汇村金星'
                    WHEN k % 43 = 0 THEN '中国上海市浦东新区浦东新区' || {_ROAD} || n || '号公园内'
                    WHEN k % 47 = 0 THEN {_ROAD} || n || '号'
                    ELSE {_DISTRICT} || {_ROAD} || {_TAIL} END AS address,
               CASE WHEN k % 53 = 0 THEN 0e0 WHEN k % 59 = 0 THEN 10e0
                    ELSE {_LAT0} + CAST((g * 37) % 500 AS DOUBLE) / 1000e0 + CAST(m AS DOUBLE) * 0.0002e0 END AS latitude,
               CASE WHEN k % 53 = 0 THEN 0e0 WHEN k % 59 = 0 THEN 100e0
                    ELSE {_LON0} + CAST((g * 91) % 499 AS DOUBLE) / 1000e0 + CAST(m AS DOUBLE) * 0.0002e0 END AS longitude,
               CASE k % 4 WHEN 0 THEN '' WHEN 1 THEN '以现场公示为准'
                    ELSE '周一至周日 09:00-' || CAST(17 + k % 4 AS STRING) || ':00' END AS hours,
               CASE WHEN k % 5 = 0 THEN '' ELSE '设有' || {pick('步道,草坪,座椅,停车场,儿童滑梯', 'k')} || '和厕所，提供热水；面积' || CAST(g AS STRING) || '平方米。' END AS description,
               1767225600 + (k * 7919) % 31536000 AS updated_at
        FROM (SELECT c_custkey AS k, CAST(floor(c_custkey / 3) AS BIGINT) AS g, c_custkey % 3 AS m,
                     CAST(1 + CAST(floor(c_custkey / 3) AS BIGINT) % 97 AS STRING) AS n FROM @customer) c""",
    "photos_v": f"""
        SELECT 'f' || {pad('o', 10)} AS photo_id, 'p' || {pad('ck')} AS place_id, o,
               '/uploads/' || {pick('web-crawl,xhs-full,curated', 'o')} || '/' || CAST(o % 400 AS STRING) || '.webp' AS url,
               CAST(o % 7 AS INT) AS sort_order, {pick('baidu-images,sogou-images,bing-images,360-images', 'o')} AS channel,
               'n' || CAST(floor(o / 6) AS BIGINT) AS note_id, CAST(o % 6 AS INT) AS idx,
               'd' || CAST((o * 13) % 12007 AS STRING) AS digest,
               400 + (o * 37) % 1600 AS width, 300 + (o * 91) % 1500 AS height, 2e0 + CAST(o % 31 AS DOUBLE) / 10e0 AS entropy,
               (((ck % 100000) * 7919 + (o % 3) * 104729) * 2654435761) % 4611686018427387904 + CAST(power(2e0, CAST(o % 40 AS DOUBLE)) AS BIGINT) AS dhash,
               (((ck % 100000) * 104729 + (o % 5) * 7919) * 1103515245) % 4611686018427387904 + CAST(power(2e0, CAST(o % 37 AS DOUBLE)) AS BIGINT) AS phash,
               o_priority AS title
        FROM (SELECT o_orderkey AS o, o_custkey AS ck, o_orderpriority AS o_priority FROM @orders) t""",
    "vision_v": """
        SELECT photo_id, place_id, o, sort_order, digest, dhash, phash,
               CAST(o % 10 AS DOUBLE) / 10e0 AS bookshelf, CAST((o * 3) % 10 AS DOUBLE) / 10e0 AS library,
               CAST((o * 7) % 10 AS DOUBLE) / 20e0 AS desk_table, CAST((o * 11) % 13 AS DOUBLE) / 13e0 AS outdoor,
               CAST((o * 5) % 9 AS DOUBLE) / 9e0 AS food, CAST((o * 17) % 11 AS DOUBLE) / 11e0 AS people,
               CAST((o * 19) % 7 AS DOUBLE) / 7e0 AS document, CAST(o % 3 AS INT) AS face_count, CAST(o % 4 AS INT) AS human_count,
               CAST(o % 200 AS DOUBLE) / 16000e0 AS face_area, CAST(o % 100 AS DOUBLE) / 240e0 AS human_area,
               CASE o % 9 WHEN 0 THEN '小红书号' WHEN 1 THEN '2024.05.06' WHEN 2 THEN '阅览区' ELSE '' END AS txt,
               CAST(o % 100 AS DOUBLE) / 100e0 AS tx, CAST((o * 3) % 100 AS DOUBLE) / 100e0 AS ty, CAST(o % 10 AS DOUBLE) / 10e0 AS tconf
        FROM @photos_v""",
    "visits_v": f"""
        SELECT 'v' || {pad('event_id', 10)} AS id, event_id AS e, CAST(ts AS TIMESTAMP) AS created_at, 'u' || CAST(user_id AS STRING) AS openid,
               CASE WHEN event_id % 50 = 0 THEN NULL ELSE 30.5e0 + CAST((event_id * 37) % 1500 AS DOUBLE) / 1000e0 END AS latitude,
               120.7e0 + CAST((event_id * 91) % 1700 AS DOUBLE) / 1000e0 AS longitude,
               CASE WHEN event_id % 7 = 0 THEN 'n/a' ELSE CAST((event_id * 13) % 997 AS STRING) || '.5' END AS accuracy,
               CASE WHEN event_type = 'click' THEN 'location_button' ELSE event_type END AS source,
               '{{"status":' || CASE WHEN event_id % 11 = 0 THEN '1' ELSE '0' END || ',"result":{{"ad_info":{{"nation":"中国","province":"'
               || {pick('上海市,江苏省', 'event_id')} || '","city":"' || {pick('上海市,苏州市,,无锡市', 'event_id')} || '","district":"'
               || {pick('徐汇区,姑苏区,,梁溪区,浦东新区', 'event_id')} || '"}},"address_component":{{"street":"' || {pick('人民路,,前程路', 'event_id')}
               || '","street_number":""}},"formatted_addresses":{{"recommend":" 近' || {pick('图书馆,公园', 'event_id')}
               || ' "}},"pois":[{{"title":"滨河公园","category":"景点","_distance":' || CAST(event_id % 300 AS STRING)
               || '}},{{"title":"幸福家园","category":"住宅","_distance":' || CAST((event_id * 7) % 800 AS STRING) || '}}]}}}}' AS payload
        FROM @events""",
    "aliases_v": """
        SELECT 'u' || CAST(s_suppkey AS STRING) AS openid, CASE WHEN s_suppkey = 7 THEN '我自己' ELSE '访客' || CAST(s_suppkey AS STRING) END AS name
        FROM @supplier WHERE s_suppkey % 2 = 1""",
    "cands_v": f"""
        SELECT id AS place_id, 1 AS cand_no, 'address' AS kind, name AS cand_name,
               CASE k % 3 WHEN 0 THEN replace(address, '路', '公路') WHEN 1 THEN address ELSE '江苏省' || address END AS cand_address,
               latitude + 0.0003e0 AS cand_latitude, longitude AS cand_longitude FROM @places_v
        UNION ALL
        SELECT id, 2, 'address', {pick('滨河公园,社区图书馆,邻里中心', 'k')}, replace(address, '号', '1号'), latitude + 0.0011e0, longitude FROM @places_v
        UNION ALL
        SELECT id, 3, 'poi', CASE k % 4 WHEN 0 THEN name || '停车场' WHEN 1 THEN name WHEN 2 THEN substr(name, 1, 6) ELSE '无关地点' END,
               substr(address, 1, 6), latitude + CAST(k % 9 AS DOUBLE) * 0.001e0, longitude FROM @places_v""",
    "desired_v": """
        SELECT id, k, name, category, address, latitude, longitude, hours,
               CASE WHEN k % 10 = 7 THEN description || '新' ELSE description END AS description
        FROM @places_v WHERE k % 20 <> 3
        UNION ALL
        SELECT 'x' || id, k, name || '新', category, address, latitude, longitude, hours, description FROM @places_v WHERE k % 20 = 5""",
    "notes_v": """
        SELECT 'n' || CAST(o.o_orderkey AS STRING) AS note_id, p.id AS place_id, p.name AS place_name, p.category, p.address, o.o_orderkey AS o,
               CASE o.o_orderkey % 4 WHEN 0 THEN p.name WHEN 1 THEN '探店｜' || p.name WHEN 2 THEN '周末去看书' ELSE '自选大食堂' END AS title,
               CASE WHEN o.o_orderkey % 13 = 0 THEN '' ELSE '今天去了' || CASE WHEN o.o_orderkey % 3 = 0 THEN p.name ELSE '附近的图书馆' END
                 || '，适合学习' || chr(10) || '地址：' || p.address || '。' || chr(10) || '开放时间：09:00-' || CAST(15 + o.o_orderkey % 7 AS STRING) || ':00。'
                 || CASE o.o_orderkey % 5 WHEN 0 THEN '有热水，没有厕所' WHEN 1 THEN '没有热水，厕所很干净' WHEN 2 THEN '插座少，wifi 可用' WHEN 3 THEN '很安静，座位多' ELSE '人很多，比较拥挤' END END AS body,
               1577836800 + (o.o_orderkey * 86407) % 157680000 AS published
        FROM @orders o JOIN @places_v p ON o.o_custkey = p.k""",
    "links_v": f"""
        SELECT 'p' || {pad('l_suppkey')} AS place_id, l_suppkey AS k,
               'https://' || {pick('www.a.gov.cn,lib.library.cn,www.xiaohongshu.com,m.dianping.com,b.example.com,c.example.com,d.example.org,www.e.example.org,news.163.com,f.sh.cn,g.example.net,map.baidu.com', 'l_partkey')}
               || '/' || CAST(l_partkey % 60 AS STRING) || '?utm_source=x&b=' || CAST(l_partkey % 3 AS STRING) || '&a=1' AS raw_url,
               {pick('地址 开放时间,热水 插座 照片,官方服务,实景 wifi,无', 'l_partkey')} AS title, CAST(l_linenumber AS INT) AS position,
               CAST(floor(l_quantity * 7) AS INT) AS base_score, {pick('小红书,大众点评,官方,百度,其他网页', 'l_partkey')} AS channel, l_orderkey AS lo, l_partkey AS lp
        FROM @lineitem""",
    "viewports_v": """
        SELECT s_suppkey AS vid, 30.6e0 + CAST((s_suppkey * 37) % 900 AS DOUBLE) / 1000e0 AS south,
               30.6e0 + CAST((s_suppkey * 37) % 900 AS DOUBLE) / 1000e0 + CAST(1 + s_suppkey % 9 AS DOUBLE) / 40e0 AS north,
               120.1e0 + CAST((s_suppkey * 53) % 1100 AS DOUBLE) / 1000e0 AS west,
               120.1e0 + CAST((s_suppkey * 53) % 1100 AS DOUBLE) / 1000e0 + CAST(1 + s_suppkey % 7 AS DOUBLE) / 30e0 AS east,
               CAST(s_suppkey % 5 AS DOUBLE) / 8e0 AS top_ratio, CAST(s_suppkey % 3 AS DOUBLE) / 9e0 AS bottom_ratio,
               CASE s_suppkey % 4 WHEN 0 THEN '全部' WHEN 1 THEN '图书馆' WHEN 2 THEN '食堂' ELSE '自然' END AS category
        FROM @supplier""",
    "origins_v": """
        SELECT event_id AS origin_id, 30.4e0 + CAST((event_id * 37) % 1700 AS DOUBLE) / 1000e0 AS latitude,
               119.9e0 + CAST((event_id * 91) % 2300 AS DOUBLE) / 1000e0 AS longitude FROM @events""",
    "pois_v": f"""
        SELECT 'q' || {pad('p')} AS id, p AS k, {pick('苏州市,南通市,无锡市,嘉兴市,镇江市', 'p')} AS city,
               {pick('姑苏区,崇川区,梁溪区,南湖区,京口区', 'p')} AS district,
               {pick('前程,新闸,岳阳,人民,太湖,共和,长海', 'p')} || CAST(CAST(floor(p / 4) AS BIGINT) % 300 AS STRING)
               || {pick('湿地公园,公园,山,停车场,生态园,古镇景区,森林公园,湖,公园东门,与前程路交叉口,植物园,多肉植物园,公园（东门）,绿道,风景区', 'p')} AS name,
               {pick('苏州市姑苏区,南通市崇川区,无锡市梁溪区,嘉兴市南湖区,镇江市京口区', 'p')} || '前程路' || CAST(1 + p % 90 AS STRING) || CASE WHEN p % 19 = 0 THEN '号公园内' ELSE '号' END AS address,
               CASE WHEN p % 17 = 0 THEN 'Store' WHEN p % 2 = 0 THEN 'Park' ELSE '' END AS map_category,
               31.0e0 + CAST((CAST(floor(p / 4) AS BIGINT) * 37) % 500 AS DOUBLE) / 1000e0 + CAST(p % 4 AS DOUBLE) * 0.0003e0 AS latitude,
               120.0e0 + CAST((CAST(floor(p / 4) AS BIGINT) * 91) % 499 AS DOUBLE) / 1000e0 AS longitude
        FROM (SELECT p_partkey AS p FROM @part) t""",
}


def _refs(sql: str) -> list[str]:
    return re.findall(r"@(\w+)", sql)


def cte(*names: str, table=lambda n: n) -> str:
    """WITH clause that defines the named derived tables and everything they need."""
    order: list[str] = []

    def visit(n):
        if n in BASE or n in order:
            return
        for r in _refs(DERIVED[n]):
            visit(r)
        order.append(n)

    for n in names:
        visit(n)
    fill = lambda m: table(m.group(1)) if m.group(1) in BASE else m.group(1)
    return "WITH " + ",\n".join(f"{n} AS ({re.sub(r'@(\w+)', fill, DERIVED[n])})" for n in order)


# Spark stores whole tables, also columns that a check never looks at; a product that passes 2^63 is taken there in DECIMAL,
# with the same value wherever BIGINT can hold it
WIDE = {
    "(((ck % 100000) * 104729 + (o % 5) * 7919) * 1103515245) % 4611686018427387904":
        "CAST((CAST((ck % 100000) * 104729 + (o % 5) * 7919 AS DECIMAL(20, 0)) * 1103515245) % 4611686018427387904 AS BIGINT)",
}


def stored_sql(name: str, path) -> str:
    """Spark text of one derived table; `path` gives the place of each table it reads."""
    sql = DERIVED[name]
    for narrow, wide in WIDE.items():
        sql = sql.replace(narrow, wide)
    return re.sub(r"@(\w+)", lambda m: f"parquet.`{path(m.group(1))}`", sql)


_STORED: dict[tuple[str, str, str], str] = {}
FILE_ROWS = 1_000_000  # rows of one stored file, so that the task that writes it does not grow with the table


class Tables:
    """Base and derived tables of one data folder.

    A derived table is written once per session as Parquet, like the stored place tables it stands for, so that
    column pruning and pushed filters work on it.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def path(self, name: str) -> str:
        if name in BASE:
            return f"{self.folder}/{name}.parquet"
        key = (self.spark.sparkContext.applicationId, self.folder, name)
        if key not in _STORED:
            sql = stored_sql(name, self.path)
            target = scratch_path(self.spark, name)
            # at least as many files as cores, so that later scans are not one task
            self.spark.sql(sql).repartition(max(self.spark.sparkContext.defaultParallelism, self.files(name))).write.parquet(target)
            _STORED[key] = target
        return _STORED[key]

    def files(self, name: str) -> int:
        """Files of a derived table; its tables' row counts, which Parquet footers hold, bound its own."""
        return -(-sum(self(ref).count() for ref in _refs(DERIVED[name])) // FILE_ROWS)

    def __call__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))
