"""Near-duplicate embeddings by lattice hashing: random projections decoded to E8 lattice points.

A table projects unit vectors on `BLOCKS` times 8 random orthogonal directions, shifts them at random and decodes each
8-dimensional block to the nearest point of the E8 lattice; the points together name a cell. A vector is put into
its own cell and into the neighbouring cells that lie nearest to it (`PROBES` cells a table), and two vectors are
candidates if they share a cell in any table. Candidates are verified by their cosine in double precision.

Measured by simulation in 64 dimensions, three tables of six probes find over 0.99 of the pairs at a cosine of 0.90 and
over 0.999 of those at 0.95; about 1 of 50 unrelated pairs is compared. More blocks make cells finer for more vectors.

A pair may share many cells. It is counted in one of them only, the first that both have in common, so links are
counted without giving out pairs: each cell gives every member its count and its root in a local spanning forest.
Equal vectors are one node with a multiplicity. A cell over `CHUNK` nodes is dealt out as pairs of chunks.
"""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, LongType

from placeloom.llm.common import cut_lineage
from placeloom.llm.unionfind import join_sets, roots
from placeloom.operators.graph import components

TABLES, PROBES, BLOCKS, SCALE, SEED = 3, 6, 2, 1.0, 17
NEAR = 4  # cells of one block that enter the choice of probes
CHUNK = 2048
ROWS = 256  # rows of the similarity matrix at a time


def _minimal() -> np.ndarray:
    """The 240 shortest vectors of E8: the steps to the neighbouring cells."""
    out = []
    for i, j in itertools.combinations(range(8), 2):
        for s, t in itertools.product((1.0, -1.0), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = s, t
            out.append(v)
    out += [np.array(s) for s in itertools.product((0.5, -0.5), repeat=8) if sum(x < 0 for x in s) % 2 == 0]
    return np.array(out)


STEPS = _minimal()


def _even(y: np.ndarray) -> np.ndarray:
    """Nearest point of D8, the integer points of even sum: round, then turn the coordinate that is furthest off."""
    r = np.rint(y)
    d = y - r
    odd = np.flatnonzero(r.sum(axis=1) % 2)
    at = np.abs(d[odd]).argmax(axis=1)
    r[odd, at] += np.where(d[odd, at] >= 0, 1.0, -1.0)
    return r


def decode(y: np.ndarray) -> np.ndarray:
    """Nearest E8 point: the nearer of D8 and D8 shifted by one half."""
    a, b = _even(y), _even(y - 0.5) + 0.5
    return np.where((((y - a) ** 2).sum(axis=1) <= ((y - b) ** 2).sum(axis=1))[:, None], a, b)


@functools.lru_cache(maxsize=8)
def _tables(dim: int, tables: int, blocks: int, scale: float, seed: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Directions, shift and hash multipliers of each table."""
    rng, out = np.random.default_rng([seed, dim]), []
    for _ in range(tables):
        g = rng.normal(size=(max(dim, 8 * blocks), 8 * blocks))
        q = np.linalg.qr(g)[0][:dim] * np.sqrt(dim / 8) * scale
        out.append((q, rng.uniform(0, 2, 8 * blocks), rng.integers(1, 2**62, size=8 * blocks) | 1))
    return out


def cells(v: np.ndarray, tables: int, probes: int, blocks: int, scale: float, seed: int) -> np.ndarray:
    """(rows, tables * probes) cell numbers of unit vectors, each vector's own cells first."""
    n, dim = v.shape
    out = np.empty((n, tables, probes), dtype=np.int64)
    for t, (q, shift, factor) in enumerate(_tables(dim, tables, blocks, scale, seed)):
        y = v @ q + shift
        cost, key = np.zeros((n, 1)), np.full((n, 1), t + 1, dtype=np.int64) * np.int64(dim * 2654435761 + 97)
        for b in range(blocks):
            part = y[:, 8 * b:8 * b + 8]
            own = decode(part)
            gain = (part - own) @ STEPS.T
            near = np.argsort(-gain, axis=1, kind="stable")[:, :NEAR - 1]
            extra = np.concatenate((np.zeros((n, 1)), 2 - 2 * np.take_along_axis(gain, near, 1)), axis=1)
            points = np.concatenate((own[:, None], own[:, None] + STEPS[near]), axis=1)
            code = (np.rint(2 * points).astype(np.int64) * factor[8 * b:8 * b + 8]).sum(axis=2)
            cost = (cost[:, :, None] + extra[:, None]).reshape(n, -1)
            key = (key[:, :, None] * np.int64(6364136223846793005) + code[:, None]).reshape(n, -1)
        best = np.argsort(cost, axis=1, kind="stable")[:, :probes]
        out[:, t] = np.take_along_axis(key, best, 1)
    return out.reshape(n, -1)


def _unit(column: pa.Array, dim: int) -> np.ndarray:
    v = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), dim)
    v = v / np.abs(v).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def _links(v, keys, key, own, lo, hi, copies, threshold, tables) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows with links in one cell, the links counted here, and their roots."""
    n = len(v)
    lab, counted, any_link = np.arange(n), np.zeros(n, dtype=np.int64), np.zeros(n, dtype=bool)
    for at in range(0, n, ROWS):
        i, j = np.nonzero(v[at:at + ROWS] @ v[at:].T >= threshold)
        later = j > i
        i, j = i[later] + at, j[later] + at
        if not len(i):
            continue
        join_sets(lab, i, j)
        any_link[i] = any_link[j] = True
        for k in range(0, len(i), 65_536):
            a, b = i[k:k + 65_536], j[k:k + 65_536]
            mine = (np.minimum(own[a], own[b]) == lo) & (np.maximum(own[a], own[b]) == hi)
            a, b = a[mine], b[mine]
            # the first common cell: the first table that has one, and there the smallest number
            first, open_ = np.zeros(len(a), dtype=np.int64), np.ones(len(a), dtype=bool)
            for t in range(tables):
                x, y = keys[a, t], keys[b, t]
                shared = (x[:, :, None] == y[:, None, :]).any(axis=2)
                found = open_ & shared.any(axis=1)
                least = np.where(shared, x, np.iinfo(np.int64).max).min(axis=1)
                first[found] = least[found]
                open_ &= ~found
            here = ~open_ & (first == key)
            np.add.at(counted, a[here], copies[b[here]])
            np.add.at(counted, b[here], copies[a[here]])
    rows = np.flatnonzero(any_link)
    return rows, counted[rows], roots(lab, rows)


def near_links(nodes: DataFrame, threshold: float, tables: int, probes: int, blocks: int, scale: float, seed: int, chunk: int) -> DataFrame:
    """(node, links, root) partial counts and forest links of nodes(node, v, n), by cells."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            dims = np.diff(b.column("v").offsets.to_numpy())
            for dim in np.unique(dims).tolist():
                part = b.filter(pa.array(dims == dim))
                k = cells(_unit(part.column("v"), dim), tables, probes, blocks, scale, seed)
                yield pa.RecordBatch.from_arrays(
                    [part.column("node"), part.column("v"), part.column("n"), pa.array(list(k), pa.list_(pa.int64()))], names=["node", "v", "n", "keys"])

    placed = cut_lineage(nodes.mapInArrow(place, nodes.select("node", "v", "n").schema.add("keys", ArrayType(LongType()))))
    rows = placed.select("node", "v", "n", "keys", F.explode(F.array_distinct("keys")).alias("key"))
    hot = placed.select(F.explode(F.array_distinct("keys")).alias("key")).groupBy("key").agg(F.count(F.lit(1)).alias("m"))
    alone = hot.where(F.col("m") > 1)  # cells of one node hold no pair
    hot = cut_lineage(alone.select("key", F.when(F.col("m") > chunk, F.ceil(F.col("m") * 2 / chunk)).otherwise(1).cast("int").alias("g")))
    rows = rows.join(hot, "key").withColumn("own", F.pmod(F.xxhash64("node"), "g").cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
    rows = rows.withColumn("lo", F.least("own", "other")).withColumn("hi", F.greatest("own", "other")).drop("other", "g")
    rows = rows.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A cell's rows may cross batches: those of a batch's last cell wait for the next one."""
        rest: pa.Table | None = None

        def work(t: pa.Table) -> Iterator[pa.RecordBatch]:
            t = t.combine_chunks()
            key, lo, hi, own, node, n = (t.column(c).to_numpy() for c in ("key", "lo", "hi", "own", "node", "n"))
            edge = np.flatnonzero(np.concatenate(([True], (key[1:] != key[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1]), [True])))
            out = [[], [], []]
            for s, e in zip(edge[:-1].tolist(), edge[1:].tolist()):
                if e - s < 2:
                    continue
                v = t.column("v").slice(s, e - s).combine_chunks()
                dim = len(v.slice(0, 1).flatten())
                if len(v.flatten()) != dim * len(v):
                    continue  # cells are made for one dimension; a clash of their numbers is no candidate
                k = t.column("keys").slice(s, e - s).combine_chunks().flatten().to_numpy().reshape(e - s, tables, probes)
                at, c, root = _links(_unit(v, dim), k, key[s], own[s:e], lo[s], hi[s], n[s:e], threshold, tables)
                for o, x in zip(out, (node[s:e][at], c, node[s:e][root])):
                    o.append(x)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(o)) for o in out], names=["node", "links", "root"])

        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([b])])
            last = [t.column(c).to_numpy() for c in ("key", "lo", "hi")]
            other = np.flatnonzero((last[0] != last[0][-1]) | (last[1] != last[1][-1]) | (last[2] != last[2][-1]))
            cut = int(other[-1]) + 1 if len(other) else 0
            if cut:
                yield from work(t.slice(0, cut))
            rest = t.slice(cut)
        if rest is not None:
            yield from work(rest)

    return rows.select("key", "lo", "hi", "own", "node", "n", "v", "keys").mapInArrow(count, "node long, links long, root long")


def near_duplicates(
    vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", threshold: float = 0.9,
    tables: int = TABLES, probes: int = PROBES, blocks: int = BLOCKS, scale: float = SCALE, seed: int = SEED, chunk: int = CHUNK,
) -> DataFrame:
    """(id, n_links, component_id, kept) for every row of vectors.

    Vectors that are NULL, empty, zero, or hold NULL or non-finite components link with nothing, nor do vectors of
    different dimensions. Every row is a vector: equal rows link with each other. A NULL id takes part but names no
    component unless no other id is there. An empty table gives no rows; other columns are not read.
    """
    v = F.col(vector)
    big = F.array_max(F.transform(v, lambda x: F.abs(x)))
    finite = ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    own = vectors.select(F.col(id).alias("id"), F.when(finite & (big > 0), v).alias("v"))
    nodes = own.where("v IS NOT NULL").groupBy("v").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("head"))
    nodes = cut_lineage(nodes.withColumn("node", F.monotonically_increasing_id()))  # numbered once, then stored
    found = cut_lineage(near_links(nodes, threshold, tables, probes, blocks, scale, seed, chunk))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    label = components(found.select(F.col("node").alias("a"), F.col("root").alias("b")))
    named = nodes.join(links, "node", "left").join(label.withColumnRenamed("id", "node"), "node", "left")
    named = named.select("v", "head", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("component", "node").alias("component"))
    named = cut_lineage(named)
    least = named.groupBy("component").agg(F.min("head").alias("component_id"))
    named = named.join(least, "component").select("v", "links", "component_id")
    out = own.join(named, "v", "left").select(
        F.col("id").alias(id), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    return out.withColumn("kept", F.col(id).eqNullSafe(F.col("component_id")))
