"""Registered queries of the training-data operators, with their check SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from placeloom.llm import decontaminate, lattice, mainhtml, mixing, quality, secrets, sharding, simhash, spelling, subvectors, tokens, warc, windows
from placeloom.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def checked(sql: str):
    def wrap(fn):
        CHECKS[fn.__name__] = sql
        return query(fn)

    return wrap


@query
def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return tokens.token_counts(docs).select("doc_id", "n_bytes", "n_tokens", "over_limit")


@query
def op3_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return simhash.groups(docs).select(F.col("id").alias("doc_id"), simhash.hex16(F.col("fp")).alias("fingerprint"), "component_id")


def fold(id: str = "doc_id"):
    """Remainder that deals documents into folds; fold 1 is held out."""
    return F.crc32(F.col(id).cast("string")) % 3


def quality_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> quality.Model:
    return quality.fit(docs, table(spark, sf_dir, "labels"), use=fold() != 1)


@query
def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = quality.scored(docs, quality_model(spark, docs, sf_dir))
    return out.select("doc_id", F.coalesce(fold() == 1, F.lit(False)).alias("held_out"), "score", "predicted")


# distinct word shingles of a text: five words, or all of a shorter text
SHINGLES_SQL = """
shingles(side, id, n_words, shingle) AS (
  SELECT DISTINCT side, id, len(w), array_to_string(w[i:i + least(len(w), 5) - 1], ' ')
  FROM (SELECT side, id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i
        FROM (SELECT side, id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w
              FROM texts)
        WHERE len(w) > 0))
"""


@checked(
    f"""
WITH texts(side, id, text) AS (
  SELECT 'd', doc_id, text FROM documents UNION ALL SELECT 'i', item_id, text FROM benchmark),
{SHINGLES_SQL},
sized AS (SELECT id, count(*) AS n FROM shingles WHERE side = 'i' GROUP BY id)
SELECT d.id AS doc_id, i.id AS item_id, count(*) AS shared, max(n) AS n, count(*) / max(n) AS containment
FROM shingles i JOIN shingles d ON d.side = 'd' AND d.shingle = i.shingle JOIN sized s ON s.id = i.id
WHERE i.side = 'i'
GROUP BY d.id, i.id HAVING count(*) >= ceil(0.8 * max(n) - 1e-9)
"""
)
def op6_contained_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


# Mixture of op2 and of the pipeline: target weights of the domains, of the languages in each, and of the sources in each.
DOMAIN_WEIGHTS = {"web": 5, "books": 3, "forum": 2}
LANG_WEIGHTS = {"en": 6, "de": 2, "fr": 2, "es": 1}


def mixing_levels():
    """Domain (from the source's number), language, source."""
    number = F.coalesce(F.expr("try_cast(regexp_extract(source, '([0-9]+)$', 1) AS INT)"), F.lit(0))
    domain = F.when(number % 3 == 0, "web").when(number % 3 == 1, "books").otherwise("forum")
    return {"domain": domain, "lang": F.col("lang"), "source": F.col("source")}


def mixing_weights(spark: SparkSession) -> DataFrame:
    """Sources weigh the same inside their language, so they have no rows."""
    rows = [(d, None, None, w) for d, w in DOMAIN_WEIGHTS.items()]
    rows += [(d, g, None, w) for d in DOMAIN_WEIGHTS for g, w in LANG_WEIGHTS.items()]
    return spark.createDataFrame(rows, "domain string, lang string, source string, weight long")


def _values(d: dict) -> str:
    return ", ".join(f"('{k}', {v})" for k, v in d.items())


def _level_sql(name: str, parent: str, keys: str, parent_keys: str, weight: str, key: str) -> str:
    """One level of the water fill: `name` gets (keys, capacity, budget) from `parent`'s budgets."""
    over = f"PARTITION BY {parent_keys}" if parent_keys else ""
    by = f"({over} ORDER BY capacity / weight, {key}"
    join = f"JOIN {parent} USING ({parent_keys})" if parent_keys else f"CROSS JOIN {parent}"
    return f"""
{name}_nodes AS (SELECT x.*, b.budget AS up FROM (SELECT {keys}, sum(capacity)::HUGEINT AS capacity, ({weight})::HUGEINT AS weight FROM leaves GROUP BY {keys}) x
  {join.replace(parent, parent + ' b')}),
{name}_sums AS (SELECT *, coalesce(sum(capacity) OVER {by} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::HUGEINT AS before,
  sum(weight) OVER {by} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::HUGEINT AS later FROM {name}_nodes),
{name}_full AS (SELECT *, capacity * later <= (up - before) * weight AS is_full FROM {name}_sums),
{name}_open AS (SELECT *, up - (sum(CASE WHEN is_full THEN capacity ELSE 0 END) OVER ({over}))::HUGEINT AS rest,
  (sum(CASE WHEN is_full THEN 0 ELSE weight END) OVER ({over}))::HUGEINT AS open_ FROM {name}_full),
{name} AS (SELECT {keys}, CASE WHEN is_full THEN capacity ELSE least(capacity, rest * weight // nullif(open_, 0)) END AS budget FROM {name}_open)"""


def mixing_sql(docs: str, fraction: float, epochs: int, seed: int) -> str:
    """CTEs up to `mixed`(d.*, domain, epoch, n_tokens) for the table or CTE `docs`."""
    return f"""
d AS (SELECT *, CASE coalesce(TRY_CAST(regexp_extract(source, '([0-9]+)$', 1) AS INT), 0) % 3 WHEN 0 THEN 'web' WHEN 1 THEN 'books' ELSE 'forum' END AS domain,
  coalesce(lang, '') AS lang_, coalesce(source, '') AS source_, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS n_tokens FROM {docs}),
leaves AS (SELECT domain, lang_, source_, sum(n_tokens)::HUGEINT AS tokens, sum(n_tokens)::HUGEINT * {epochs} AS capacity FROM d GROUP BY ALL),
domain_weight(domain, w) AS (VALUES {_values(DOMAIN_WEIGHTS)}), lang_weight(lang_, w) AS (VALUES {_values(LANG_WEIGHTS)}),
root AS (SELECT floor(sum(tokens) * {fraction})::HUGEINT AS budget FROM leaves),
{_level_sql('l1', 'root', 'domain', '', 'coalesce((SELECT w FROM domain_weight q WHERE q.domain = leaves.domain), 1)', 'domain')},
{_level_sql('l2', 'l1', 'domain, lang_', 'domain', 'coalesce((SELECT w FROM lang_weight q WHERE q.lang_ = leaves.lang_), 1)', 'lang_')},
{_level_sql('l3', 'l2', 'domain, lang_, source_', 'domain, lang_', '1', 'source_')},
bought AS (SELECT domain, lang_, source_, budget // tokens AS whole, budget % tokens AS part FROM l3 JOIN leaves USING (domain, lang_, source_) WHERE budget > 0),
placed AS (SELECT d.*, whole, part, md5(concat('{seed}:', whole::VARCHAR, ':', coalesce(doc_id::VARCHAR, ''))) AS h FROM d JOIN bought USING (domain, lang_, source_)),
started AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang_, source_ ORDER BY h) - sum(n_tokens) OVER (PARTITION BY domain, lang_, source_, h) AS start_ FROM placed),
mixed AS (SELECT *, unnest(range(0, (whole + CASE WHEN start_ < part THEN 1 ELSE 0 END)::BIGINT)) AS epoch FROM started)
"""


OP2 = {"fraction": 0.5, "epochs": 2, "seed": 1}


@checked(f"WITH {mixing_sql('documents', **OP2)} SELECT doc_id, domain, lang, source, epoch, n_tokens FROM mixed")
def op2_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    tokens = docs.select("doc_id", "lang", "source", mixing.word_tokens().alias("n"))
    out = mixing.mix(tokens, mixing_weights(spark), mixing_levels(), tokens=F.col("n"), **OP2)
    return out.select("row.doc_id", "domain", "row.lang", "row.source", "epoch", "n_tokens")


@checked(
    """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
d AS (SELECT page_id, octet_length(body) AS payload_bytes, sha256(body) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 100 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND first <> page_id THEN first END AS refers_to
FROM f
"""
)
def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_digest(spark, warc.archive_pages(table(spark, sf_dir, "pages")))


SHARD_BYTES = 1 << 20


def sharding_sql(docs: str, limit: int = SHARD_BYTES) -> str:
    """CTEs up to `sharded`(d.*, bytes, depth, prefix, shard, shard_bytes, over_limit) for the table or CTE `docs`."""
    return f"""
placed AS (SELECT *, coalesce(octet_length(encode(text)), 0) AS bytes,
  ('0x' || substr(md5('0:' || coalesce(doc_id::VARCHAR, md5(coalesce(text, '')))), 1, 15))::BIGINT AS a FROM {docs}),
sizes AS (SELECT a, sum(bytes) AS n FROM placed GROUP BY a),
nodes AS (SELECT depth, a >> (60 - depth) AS prefix, sum(n) AS shard_bytes, min(a) = max(a) AS single
  FROM sizes, range(0, 61) t(depth) GROUP BY ALL),
chosen AS (SELECT a, min(depth) AS depth FROM sizes, range(0, 61) t(depth)
  JOIN nodes USING (depth) WHERE nodes.prefix = a >> (60 - depth) AND (shard_bytes <= {limit} OR single) GROUP BY a),
sharded AS (SELECT p.*, depth, prefix, CASE WHEN depth = 0 THEN '' ELSE lpad(bin(prefix), depth::INT, '0') END AS shard, shard_bytes::BIGINT AS shard_bytes,
  shard_bytes > {limit} AS over_limit
  FROM placed p JOIN chosen USING (a) JOIN nodes USING (depth) WHERE prefix = a >> (60 - depth))
"""


@checked(f"WITH {sharding_sql('documents')} SELECT doc_id, bytes, shard, shard_bytes, over_limit FROM sharded")
def op8_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return sharding.shard_of(docs, SHARD_BYTES).select("row.doc_id", "bytes", "shard", "shard_bytes", "over_limit")


@query
def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mainhtml.main_text(table(spark, sf_dir, "pages"))


@query
def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return secrets.secrets(docs, secrets.fit(docs))


@query
def op9_lattice_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.near_duplicates(table(spark, sf_dir, "embeddings"))


OP13 = {"k": 40, "rounds": 5, "seed": 2}


def clustering_sql(k: int, rounds: int, seed: int) -> str:
    """Lloyd rounds over plain vectors, one CTE a round; floor(s / n) in whole numbers."""
    near = """SELECT id, v, c FROM (SELECT v.id, v.row_, v.v, c.c, row_number() OVER (PARTITION BY v.row_ ORDER BY
      list_sum(list_transform(list_zip(v.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))), c.c) AS rank_ FROM vectors v, {c} c) WHERE rank_ = 1"""
    steps = "".join(f"""
near{i} AS MATERIALIZED ({near.format(c=f'c{i}')}),
flat{i} AS (SELECT c, j, sum(v[j])::HUGEINT AS s, count(*) AS n FROM near{i}, range(1, 65) t(j) GROUP BY ALL),
mean{i} AS (SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY j) AS v FROM flat{i} GROUP BY c),
c{i + 1} AS MATERIALIZED (SELECT c{i}.c, coalesce(mean{i}.v, c{i}.v) AS v FROM c{i} LEFT JOIN mean{i} USING (c)),""" for i in range(rounds))
    return f"""
WITH vectors AS MATERIALIZED (
  SELECT vec_id AS id, row_number() OVER () AS row_, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('{seed}:' || id::VARCHAR)) - 1 AS c, v
  FROM (SELECT * FROM vectors ORDER BY sha256('{seed}:' || id::VARCHAR) LIMIT {k})),{steps}
last AS (SELECT n.id, n.c, list_sum(list_transform(list_zip(n.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d, c.v
  FROM ({near.format(c=f'c{rounds}')}) n JOIN c{rounds} c USING (c))
SELECT id AS vec_id, c::INT AS cluster, d::BIGINT AS distance, (sum(d) OVER (PARTITION BY c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(v, ',')) AS centroid_sha256
FROM last
"""


@checked(clustering_sql(**OP13))
def op13_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return subvectors.clusters(table(spark, sf_dir, "embeddings"), **OP13)


# crc32 by its rule: the table of 256 steps of the reversed polynomial, then one step a byte
CRC_SQL = """
crc_table AS (SELECT list(list_reduce(list_prepend(b, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY b) AS t
  FROM range(256) r(b))"""
CRC_OF = """xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(octet_length(encode({s}))),
  lambda i: ('0x' || substr(hex(encode({s})), (2 * i + 1)::INT, 2))::BIGINT)), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)))"""


@checked(
    f"""
WITH RECURSIVE {CRC_SQL},
runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, '{spelling.UPPER}', '{spelling.UPPER.lower()}'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
each AS (SELECT run, coalesce(doc_id::VARCHAR, '') || ':' || run AS s, count(*) AS n FROM runs WHERE length(run) >= 5 GROUP BY ALL),
hashed AS (SELECT run, n, {CRC_OF.format(s='s')} AS h FROM each, crc_table),
slipped AS (SELECT n, CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run) + 2)::INT) ELSE run END AS word FROM hashed),
words AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM slipped WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
cut AS MATERIALIZED (SELECT word, n, i, substr(word, 1, (i - 1)::INT) || substr(word, (i + 1)::INT) AS rest FROM words, range(1, length(word) + 1) t(i)),
pairs AS MATERIALIZED (
  SELECT a.word, b.word AS other, b.n FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cut a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM cut a JOIN words b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, max(n) AS top FROM pairs GROUP BY word),
named AS (SELECT word, n_near, top, min(other) AS best FROM best JOIN pairs USING (word) WHERE pairs.n = top GROUP BY ALL),
forms AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN top >= 2 * w.n THEN best END AS form, CASE WHEN top >= 2 * w.n THEN top END AS form_n
  FROM words w LEFT JOIN named USING (word)),
walk AS (SELECT word, word AS tip FROM forms UNION ALL SELECT walk.word, form FROM walk JOIN forms ON forms.word = walk.tip WHERE form IS NOT NULL),
ends AS (SELECT walk.word, tip AS root FROM walk JOIN forms ON forms.word = tip WHERE form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN ends USING (word)
"""
)
def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


@checked(
    """
WITH w AS (SELECT doc_id, row_number() OVER () AS row_, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
places AS MATERIALIZED (SELECT doc_id, row_, i, array_to_string(w[i:i + 12], ' ') AS seen FROM w, range(1, len(w) - 11) t(i)),
first AS (SELECT seen, min(doc_id) AS first FROM places GROUP BY seen),
starts AS (SELECT row_, list(i) AS starts FROM places JOIN first USING (seen) WHERE first < doc_id GROUP BY row_),
gone AS (SELECT row_, unnest(list_distinct(flatten(list_transform(starts, lambda i: range(i, i + 13))))) AS i FROM starts),
kept AS (SELECT row_, string_agg(word, ' ' ORDER BY i) AS kept, count(*) AS n FROM (SELECT row_, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM w)
  ANTI JOIN gone USING (row_, i) GROUP BY row_)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM w LEFT JOIN kept USING (row_)
"""
)
def op12_repeated_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = windows.dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
