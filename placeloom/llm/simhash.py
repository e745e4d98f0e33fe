"""Near-duplicate groups by SimHash: pivot distance tables discard candidate pairs before the exact test.

Fingerprints are linked at `DIFF` = 3 or fewer differing bits. The 64 bits are cut into 6 blocks; 3 differing bits
leave at least 3 blocks alike, so every linked pair of different fingerprints meets under one of the 20 keys made
of 3 blocks (32 or 33 bits, so a bucket grows with N / 2^32). Inside a bucket each fingerprint gets its table of Hamming
distances to 16 reference fingerprints; by the triangle inequality a pair whose largest coordinate difference is
over 3 is no link, and what survives is verified bit by bit. Only a spanning forest of each bucket is
given out, never its pairs, and the forests together have the components of all links.

Equal fingerprints are one node. A bucket with more than `CHUNK` nodes is dealt out as pairs of chunks, so a task
holds two chunks whatever the bucket's size.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from placeloom.llm.common import cut_lineage, text_batches, text_of
from placeloom.llm.unionfind import join_sets, roots
from placeloom.operators.graph import components

DIFF = 3
WIDTHS = (11, 11, 11, 11, 10, 10)
CHUNK = 4096  # nodes of one bucket chunk
STEP = 65_536  # shingles hashed at a time


def _mix(x: int) -> int:
    """splitmix64: the rule that makes the reference fingerprints."""
    x = (x + 0x9E3779B97F4A7C15) % 2**64
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 % 2**64
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB % 2**64
    return x ^ (x >> 31)


PIVOTS = np.array([_mix(i) for i in range(16)], dtype=np.uint64)


def fingerprint(text: str | None, words: int = 3, seed: int = 42) -> int:
    """Unsigned SimHash of the word shingles, repeats included; 0 for a text without words."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: lower-cases A-Z, splits at ASCII white space only
    if not w:
        return 0
    line = b" ".join(w)
    ends = np.cumsum(np.fromiter(map(len, w), dtype=np.int64, count=len(w)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(words, len(w))
    a, b = starts[:len(w) - k + 1], ends[k - 1:]
    f, ones = xxhash.xxh64_intdigest, np.zeros(64, dtype=np.int64)
    for i in range(0, len(a), STEP):
        h = np.array([f(line[x:y], seed) for x, y in zip(a[i:i + STEP].tolist(), b[i:i + STEP].tolist())], dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(a), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id: str = "doc_id", text: str = "text", words: int = 3, seed: int = 42) -> DataFrame:
    """(id, fp): one narrow pass; fp is the fingerprint as a signed long."""

    @F.pandas_udf("long")
    def fp(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(np.array([fingerprint(t, words, seed) for t in s], dtype=np.uint64).view(np.int64))

    return text_batches(docs).select(F.col(id).alias("id"), fp(text_of(text)).alias("fp"))


def _keys(fp: Column) -> list[Column]:
    at, parts = 0, []
    for w in WIDTHS:
        parts.append((F.shiftrightunsigned(fp, at).bitwiseAND(F.lit((1 << w) - 1)), w))
        at += w
    keys = []
    for n, chosen in enumerate(itertools.combinations(range(len(WIDTHS)), len(WIDTHS) - DIFF)):
        key = F.lit(n).cast("long")
        for i in chosen:
            part, w = parts[i]
            key = F.shiftleft(key, w).bitwiseOR(part)
        keys.append(key)
    return keys


def forest(bucket: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest within runs of equal `bucket` (rows are sorted by it)."""
    n = len(fp)
    if n < 2:
        return fp[:0], fp[:0]
    new = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
    size = np.diff(np.append(new, n))
    keep = np.repeat(size > 1, size)
    fp, end = fp[keep], np.cumsum(size[size > 1])
    end = np.repeat(end, size[size > 1])
    u = fp.view(np.uint64)
    table = np.bitwise_count(u[:, None] ^ PIVOTS[None, :]).astype(np.int8)  # the pivot distance table
    lab, at = np.arange(len(fp)), np.arange(len(fp))
    for d in range(1, int(size.max())):
        at = at[at + d < end[at]]
        i = at
        for p in range(table.shape[1]):
            i = i[np.abs(table[i, p] - table[i + d, p]) <= DIFF]
        i = i[np.bitwise_count(u[i] ^ u[i + d]) <= DIFF]
        join_sets(lab, i, i + d)
    root = roots(lab, np.arange(len(fp)))
    moved = np.flatnonzero(root != np.arange(len(fp)))
    return fp[moved], fp[root[moved]]


def _forests(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Runs of one bucket may cross batches: the last run of a batch waits for the next one."""
    rest_k, rest_f = np.empty(0, np.int64), np.empty(0, np.int64)
    for pdf in batches:
        k, f = np.concatenate((rest_k, pdf["bucket"].to_numpy())), np.concatenate((rest_f, pdf["fp"].to_numpy()))
        if not len(k):
            continue
        cut = int(np.flatnonzero(k != k[-1])[-1]) + 1 if (k != k[-1]).any() else 0
        a, b = forest(k[:cut], f[:cut])
        yield pd.DataFrame({"a": a, "b": b})
        rest_k, rest_f = k[cut:], f[cut:]
    a, b = forest(rest_k, rest_f)
    yield pd.DataFrame({"a": a, "b": b})


def links(distinct: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """(a, b) forest links between the different fingerprints of `distinct(fp)`."""
    keyed = distinct.select("fp", F.explode(F.array(*_keys(F.col("fp")))).alias("key"))
    hot = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > chunk)
    hot = cut_lineage(hot.select("key", F.ceil(F.col("n") / (chunk / 2)).cast("int").alias("g")))  # few rows: N * 20 / chunk at most
    g = F.coalesce("g", F.lit(1))
    own = F.pmod(F.xxhash64("fp"), g)
    other = F.explode(F.sequence(F.lit(0), g - 1))
    cells = keyed.join(hot, "key", "left").select("fp", "key", g.alias("g"), own.alias("own"), other.alias("other"))
    cell = F.least("own", "other") * F.col("g") + F.greatest("own", "other")
    cells = cells.select("fp", F.when(F.col("g") == 1, F.col("key")).otherwise(F.xxhash64("key", cell)).alias("bucket"))
    cells = cells.repartition("bucket").sortWithinPartitions("bucket")
    return cells.mapInPandas(_forests, "a long, b long")


def groups(docs: DataFrame, id: str = "doc_id", text: str = "text", words: int = 3, seed: int = 42, chunk: int = CHUNK) -> DataFrame:
    """(id, fp, component_id) for every row; component_id is the smallest id reachable over links, itself included.

    NULL and empty texts have no words and fingerprint 0, linked like any other; repeated rows come out each; a
    NULL id takes part in its group but is never its smallest unless no other id is there; an empty table gives
    no rows. Other columns of docs are not read.
    """
    digest = cut_lineage(fingerprints(docs, id, text, words, seed))
    nodes = cut_lineage(digest.groupBy("fp").agg(F.min("id").alias("head")))
    label = components(links(nodes.select("fp"), chunk))
    nodes = nodes.join(label.withColumnRenamed("id", "fp"), "fp", "left")
    nodes = cut_lineage(nodes.select("fp", "head", F.coalesce("component", "fp").alias("component")))
    least = nodes.groupBy("component").agg(F.min("head").alias("component_id"))
    nodes = cut_lineage(nodes.join(least, "component").select("fp", "component_id"))
    return digest.join(nodes, "fp").select("id", "fp", "component_id")


def keep_one(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one row of each near-duplicate group, the one with the smallest id; all columns as they were.

    Rows without an id cannot be told apart and stay. Rows that repeat an id count as one document.
    """
    g = groups(docs, id, text)
    heads = g.where(F.col("id") == F.col("component_id")).select(F.col("id").alias(id)).distinct()
    kept = docs.join(cut_lineage(heads), id, "left_semi").dropDuplicates([id])
    return kept.unionByName(docs.where(F.col(id).isNull()))


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
