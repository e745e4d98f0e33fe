"""Sharding by extendible hashing: only buckets over the byte limit split, one hash bit at a time.

A document's address is a 60-bit hash of its id. The directory starts with one bucket; a bucket whose texts have more
bytes than the limit splits on the next bit of the address, until every bucket fits. That gives the same buckets as
taking, for each address, the shortest prefix whose bytes fit, and it is computed that way: byte sums of cells of
addresses, rolled up along their prefixes. Cells are about 1/16 of a bucket at first; only cells that are over the
limit themselves are opened further, eight bits at a time. All of this works on sums; documents are read for
(address, bytes) and joined with the directory by cell.

A bucket that holds one address only cannot be split. If it is over the limit (a document longer than the limit, or
one id repeated very often) it is a shard by itself with over_limit set.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from placeloom.llm.common import cut_lineage, text_of

BITS = 60
SPREAD = 4  # first cells are 2^-SPREAD of a bucket
STEP = 8  # bits opened at a time in a cell over the limit


def address(id: Column, text: Column, seed: int = 0) -> Column:
    """60 hash bits of the id; of the text where the id is NULL."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(id.cast("string"), F.md5(F.encode(text, "UTF-8"))))
    return F.conv(F.substring(F.md5(key), 1, BITS // 4), 16, 10).cast("long")


def _prefix(a: Column, depth: Column | int) -> Column:
    return F.call_function("shiftright", a, (F.lit(BITS) - (F.lit(depth) if isinstance(depth, int) else depth)).cast("int"))


def directory(sizes: DataFrame, limit: int) -> tuple[DataFrame, int]:
    """((cell, depth, prefix, shard_bytes, over_limit), d): the shards of sizes(a: address, n: bytes).

    cell is the first d bits of the addresses; a shard of depth <= d has a row for each of its cells that has
    documents, a deeper one has a single row.
    """
    total = sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    first = min(BITS, max(0, math.ceil(math.log2(max(total / limit, 1))) + SPREAD))
    found, low, depth, todo = None, 0, first, sizes
    while True:
        cells = todo.groupBy(_prefix(F.col("a"), depth).alias("cell")).agg(F.sum("n").alias("n"), F.min("a").alias("lo"), F.max("a").alias("hi"))
        cells = cut_lineage(cells)
        up = cells.withColumn("depth", F.explode(F.sequence(F.lit(low), F.lit(depth))))
        up = up.withColumn("prefix", F.call_function("shiftright", F.col("cell"), F.lit(depth) - F.col("depth")))
        nodes = up.groupBy("depth", "prefix").agg(F.sum("n").alias("shard_bytes"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))
        fits = nodes.where((F.col("shard_bytes") <= limit) | (F.col("lo") == F.col("hi"))).select("depth", "prefix", "shard_bytes")
        # the shortest prefix of each cell that is a bucket; NULL if the cell has to be opened
        own = up.select("cell", "depth", "prefix").join(fits, ["depth", "prefix"])
        own = own.groupBy("cell").agg(F.min_by(F.struct("depth", "prefix", "shard_bytes"), "depth").alias("s"))
        own = cut_lineage(cells.select("cell").join(own, "cell", "left").select("cell", "s.*"))
        done = own.where("depth IS NOT NULL").withColumn("cell", F.call_function("shiftright", F.col("cell"), F.lit(depth - first)))
        done = done.distinct()
        found = done if found is None else found.unionByName(done)
        over = own.where("depth IS NULL").select("cell")
        if depth == BITS or over.isEmpty():
            break
        todo = cut_lineage(todo.join(over, _prefix(todo["a"], depth) == over["cell"], "left_semi"))
        low, depth = depth + 1, min(BITS, depth + STEP)
    return cut_lineage(found.withColumn("over_limit", F.col("shard_bytes") > limit)), first


def shard_of(docs: DataFrame, limit: int, id: str = "doc_id", text: str = "text", seed: int = 0) -> DataFrame:
    """(row: struct of docs' columns, bytes, shard, shard_bytes, over_limit) for every row.

    shard is the bucket's bit string ('' for a single bucket). NULL and empty texts have 0 bytes; rows of one id have
    one address and so one shard; rows without an id are dealt by their text; an empty table gives no rows.
    """
    own = docs.select(
        F.struct(*docs.columns).alias("row"), address(F.col(id), text_of(text), seed).alias("a"), F.octet_length(text_of(text)).cast("long").alias("n"))
    shards, d = directory(cut_lineage(own.select("a", "n")), limit)
    own = own.withColumn("cell", _prefix(F.col("a"), d))
    out = own.join(shards, (own["cell"] == shards["cell"]) & (_prefix(own["a"], shards["depth"]) == shards["prefix"]))
    name = F.when(F.col("depth") == 0, "").otherwise(F.call_function("lpad", F.bin("prefix"), F.col("depth"), F.lit("0")))
    return out.select("row", F.col("n").alias("bytes"), name.alias("shard"), "shard_bytes", "over_limit")


def write_shards(docs: DataFrame, path: str, limit: int, **more) -> None:
    """One folder per shard (shard=b<bits>); a task writes whole shards, each bounded by the limit."""
    out = shard_of(docs, limit, **more).select("row.*", F.concat(F.lit("b"), "shard").alias("shard_"))
    out.repartition("shard_").write.partitionBy("shard_").parquet(path)
