"""Centroid clustering of integer vectors over dictionaries of their subvectors.

A vector of `DIM` components is cut into blocks of `BLOCK` components. Vectors are stored in chunks of at most `CHUNK`
rows; a chunk holds, for each block, the distinct subvectors of its rows and one code a row, which loses nothing. A round
computes the exact squared distance of every dictionary entry to every centroid once, and a vector's distance is the sum
of its blocks' entries by code. New centroids come from code counts: a subvector counts as often as its code is assigned.

A task holds one chunk and the k centroids, no row is shuffled, and k * DIM sums a round reach the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from placeloom.llm.common import cut_lineage, drop_step

DIM = 64
BLOCK = 2  # components of a subvector
CHUNK = 16_384  # rows of a chunk
STEPS = 256  # integers a unit
LARGEST = 2**27  # with components below it, 64 squared differences fit a long
ENCODED = "ids binary, id_null binary, dictionaries array<binary>, codes array<binary>"


def integers(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(id, v) of the vectors that take part: exactly DIM components, none NULL or non-finite, as floor(STEPS * x).

    Components of LARGEST or more in size, whose distances a long cannot hold, leave a vector out as well.
    """
    v = F.col(vector).cast("array<double>")
    own = vectors.select(F.col(id).cast("long").alias("id"), v.alias("x")).where(F.size("x") == DIM)
    whole = F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < LARGEST // STEPS))
    return own.where(whole).select("id", F.transform("x", lambda x: F.floor(x * STEPS).cast("long")).alias("v"))


def encode(v: np.ndarray, block: int = BLOCK) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Dictionaries (distinct subvectors in order) and codes of each block of components; v is (rows, components)."""
    dictionaries, codes = [], []
    for i in range(0, v.shape[1], block):
        own, code = np.unique(v[:, i:i + block], axis=0, return_inverse=True)
        dictionaries.append(own)
        codes.append(code.reshape(-1))
    return dictionaries, codes


def nearest(dictionaries: list[np.ndarray], codes: list[np.ndarray], centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(cluster, squared distance) of each row; of centroids at one distance the smallest number wins."""
    total, at = np.zeros((len(codes[0]), len(centroids)), dtype=np.int64), 0
    for own, code in zip(dictionaries, codes):
        part = centroids[:, at:at + own.shape[1]]
        total += ((own[:, None, :] - part[None, :, :]) ** 2).sum(axis=2)[code]
        at += own.shape[1]
    cluster = total.argmin(axis=1)
    return cluster, total[np.arange(len(cluster)), cluster]


def sums(dictionaries: list[np.ndarray], codes: list[np.ndarray], cluster: np.ndarray, k: int) -> np.ndarray:
    """Componentwise sums of each cluster, from the counts of its codes."""
    out = []
    for own, code in zip(dictionaries, codes):
        counts = np.bincount(cluster * len(own) + code, minlength=k * len(own)).reshape(k, len(own))
        out.append(counts @ own)
    return np.concatenate(out, axis=1)


def encoded(rows: DataFrame, chunk: int = CHUNK, block: int = BLOCK) -> DataFrame:
    """Chunks of rows(id, v), dictionary-encoded and stored."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def flush():
            ids, null, v = (np.concatenate(x) for x in zip(*held))
            held.clear()
            for i in range(0, len(ids), chunk):
                dictionaries, codes = encode(v[i:i + chunk], block)
                yield pa.RecordBatch.from_pydict({
                    "ids": [ids[i:i + chunk].tobytes()], "id_null": [null[i:i + chunk].tobytes()],
                    "dictionaries": [[d.tobytes() for d in dictionaries]], "codes": [[c.astype("<i4").tobytes() for c in codes]]},
                    schema=pa.schema([("ids", pa.binary()), ("id_null", pa.binary()), ("dictionaries", pa.list_(pa.binary())), ("codes", pa.list_(pa.binary()))]))

        for b in batches:
            ids, v = b.column(0), b.column(1)
            flat = v.flatten().to_numpy(zero_copy_only=False).astype("<i8").reshape(-1, DIM)
            held.append((ids.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8"), ids.is_null().to_numpy(zero_copy_only=False), flat))
            if sum(len(x[0]) for x in held) >= chunk:
                yield from flush()
        if any(len(x[0]) for x in held):
            yield from flush()

    return cut_lineage(rows.mapInArrow(pack, ENCODED))


def _chunks(batches: Iterator[pa.RecordBatch], block: int):
    """(ids, null flags, dictionaries, codes) of each stored chunk."""
    for b in batches:
        for r in b.to_pylist():
            width = [min(block, DIM - i) for i in range(0, DIM, block)]
            dictionaries = [np.frombuffer(d, "<i8").reshape(-1, w) for d, w in zip(r["dictionaries"], width)]
            yield np.frombuffer(r["ids"], "<i8"), np.frombuffer(r["id_null"], bool), dictionaries, [np.frombuffer(c, "<i4") for c in r["codes"]]


def _round(chunks: DataFrame, centroids: np.ndarray, block: int) -> np.ndarray:
    """Centroids after one round: floor of the mean of each cluster, empty clusters as they were."""
    k = len(centroids)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(k, dtype=np.int64), np.zeros((k, DIM), dtype=np.int64)
        for _, _, dictionaries, codes in _chunks(batches, block):
            cluster, _ = nearest(dictionaries, codes, centroids)
            count += np.bincount(cluster, minlength=k)
            total += sums(dictionaries, codes, cluster, k)
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_pydict({
            "cluster": np.repeat(some, DIM).astype(np.int32), "place": np.tile(np.arange(DIM), len(some)).astype(np.int32),
            "n": np.repeat(count[some], DIM), "total": total[some].reshape(-1)})

    parts = chunks.mapInArrow(add, "cluster int, place int, n long, total long")
    out = centroids.copy()
    whole = parts.groupBy("cluster", "place").agg(F.sum("n").alias("n"), F.sum(F.col("total").cast("decimal(38,0)")).alias("total"))
    for r in whole.collect():  # k * DIM rows
        out[r["cluster"], r["place"]] = int(r["total"]) // r["n"]
    return out


def first_centroids(rows: DataFrame, k: int, seed: int) -> np.ndarray:
    """The k vectors with the smallest sha256 of '<seed>:<id>' (NULL id: empty); rows of one id by their components."""
    key = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit(""))), 256)
    found = rows.select("v", key.alias("key")).orderBy("key", "v").limit(k).collect()
    return np.array([r["v"] for r in found], dtype=np.int64).reshape(-1, DIM)


def clusters(vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", k: int = 40, rounds: int = 5, seed: int = 2,
             chunk: int = CHUNK, block: int = BLOCK) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector that takes part.

    `rounds` rounds of nearest centroid and floored mean, then one more assignment. Vectors that do not take part (see
    `integers`) have no row; with fewer than k vectors each is a centroid; an empty table gives no rows. Rows that repeat
    count each, equal centroids leave the later one empty. Other columns are not read.
    """
    spark: SparkSession = vectors.sparkSession
    rows = integers(vectors, id, vector)
    centroids = first_centroids(rows, k, seed)
    if not len(centroids):
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    chunks = encoded(rows, chunk, block)
    for _ in range(rounds):
        centroids = _round(chunks, centroids, block)
    last = centroids

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, null, dictionaries, codes in _chunks(batches, block):
            cluster, distance = nearest(dictionaries, codes, last)
            yield pa.RecordBatch.from_pydict({"vec_id": pa.array(ids, pa.int64(), mask=null), "cluster": cluster.astype(np.int32), "distance": distance})

    dealt = cut_lineage(chunks.mapInArrow(assign, "vec_id long, cluster int, distance long"))
    drop_step(chunks)
    # one row a centroid, made from the k centroids of the driver
    sha = [(i, hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest()) for i, c in enumerate(last)]
    named = spark.createDataFrame(sha, "cluster int, centroid_sha256 string")
    own = dealt.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    whole = dealt.agg(F.sum("distance").alias("inertia"))
    per = named.join(own, "cluster").crossJoin(whole)  # k rows by one row
    return dealt.join(F.broadcast(per), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
