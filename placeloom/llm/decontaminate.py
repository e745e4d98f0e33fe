"""Benchmark decontamination: size-partitioned MinHash containment search with exact verification.

Items are short and documents may be very long, so a document's own MinHash says little about an item in it. The
sketch is taken of the item instead, and asked for in whole documents: of an item's n distinct word shingles at
most floor((1 - t) n) may be missing from a document that contains it to the degree t, so any
k = floor((1 - t) n) + 1 of them include one that is there. Items are partitioned by size (powers of two), each
partition has one sketch length, that of its largest size, and an item's sketch is its k smallest shingles by hash,
shingles that many items share last. A sketch shingle in a document makes the pair a candidate; candidates are
verified by counting the shared shingles as strings. No pair above the threshold is lost.

Documents are read once. Their shingles are hashed by array operations and tested against a bit table of all
item shingles; the table has a fixed size (`BITS`), whatever the number of items, and only lets pass too much, never
too little. What passes is shuffled as (id, shingle) and joined.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from placeloom.llm.common import cut_lineage, text_batches, text_of

WORDS = 5
THRESHOLD = 0.8
BITS = 1 << 22  # sent to every task: 512 kB
SEGMENT = 1 << 20  # bytes hashed at a time
_B, _C = 0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F


@functools.lru_cache(maxsize=1)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """B^j and B^-j modulo 2^64 for j < n."""
    out = []
    for base in (_B, pow(_B, -1, 1 << 64)):
        a = np.full(n, base, dtype=np.uint64)
        a[0] = 1
        out.append(np.multiply.accumulate(a))
    return out[0], out[1]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and 64-bit hash of every word of texts that lie end to end in `data`; text i is offsets[i:i+2]."""
    space = (data == 32) | ((data >= 9) & (data <= 13))
    edge = np.zeros(len(data) + 1, dtype=bool)
    edge[offsets] = True
    begins = ~space
    ends = begins.copy()
    begins[1:] &= space[:-1] | edge[1:-1]
    ends[:-1] &= space[1:] | edge[1:-1]
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    hashes = np.empty(len(starts), dtype=np.uint64)
    i = 0
    while i < len(starts):
        # as many words as fit into a segment, one at least
        j = max(i + 1, int(np.searchsorted(stops, starts[i] + SEGMENT, "right")))
        at, to = int(starts[i]), int(stops[j - 1])
        size = max(SEGMENT, 1 << (to - at).bit_length())
        power, inverse = _powers(size)
        run = np.zeros(to - at + 1, dtype=np.uint64)
        np.cumsum((data[at:to].astype(np.uint64) + np.uint64(1)) * power[:to - at], out=run[1:])
        a, b = starts[i:j] - at, stops[i:j] - at
        hashes[i:j] = _mix((run[b] - run[a]) * inverse[a] + (b - a).astype(np.uint64))
        i = j
    return starts, stops, hashes


def runs(hashes: np.ndarray, owner: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """First word and hash of every run of k words within one text."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    h, factor = np.zeros(n, dtype=np.uint64), 1
    for j in range(k):
        h = h + hashes[j:j + n] * np.uint64(factor)
        factor = factor * _C % (1 << 64)
    at = np.flatnonzero(owner[:n] == owner[k - 1:])
    return at, _mix(h[at])


def _slots(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    m = np.uint64(bits - 1)
    return (h & m).astype(np.int64), ((h >> np.uint64(32)) & m).astype(np.int64)


def _texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None else np.empty(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def shingles_in(docs: DataFrame, table: np.ndarray | None, lengths: list[int], whole_if_short: int = 0) -> DataFrame:
    """(id, shingle): the distinct shingles of each row of docs(id, t) that the bit table lets pass (all without one).

    lengths: the numbers of words. whole_if_short = k: texts of fewer than k words give their whole word sequence,
    whatever `lengths`.
    """
    schema = docs.select("id").schema.add("shingle", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = None if table is None else np.unpackbits(table, bitorder="little").view(bool)
        for batch in batches:
            data, offsets = _texts(batch.column("t"))
            starts, stops, hashes = words_of(data, offsets)
            owner = np.searchsorted(offsets, starts, "right") - 1
            found: dict[tuple[int, bytes], None] = {}
            raw = data.tobytes() if len(starts) else b""

            def add(i: int, k: int) -> None:
                found[int(owner[i]), b" ".join(raw[a:b] for a, b in zip(starts[i:i + k].tolist(), stops[i:i + k].tolist()))] = None

            for k in lengths:
                at, h = runs(hashes, owner, k)
                if bits is not None:
                    p, q = _slots(h, len(bits))
                    at = at[bits[p] & bits[q]]
                for i in at.tolist():
                    add(i, k)
            if whole_if_short:
                first, size = np.unique(owner, return_index=True)[1], np.unique(owner, return_counts=True)[1]
                for i, k in zip(first.tolist(), size.tolist()):
                    if k < whole_if_short:
                        add(i, k)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id").take(pa.array([d for d, _ in found], pa.int64())), pa.array([s for _, s in found], pa.binary()).cast(pa.string())],
                names=["id", "shingle"])

    return text_batches(docs).mapInArrow(run, schema)


def bit_table(shingles: DataFrame, bits: int = BITS) -> np.ndarray:
    """Packed bits set for every shingle; gathered as at most bits / 64 numbers, however many shingles there are."""

    def run(batches):
        for batch in batches:
            data, offsets = _texts(batch.column("shingle"))
            _, _, hashes = words_of(data, offsets)
            owner = np.searchsorted(offsets, words_of(data, offsets)[0], "right") - 1
            size = np.bincount(owner, minlength=len(offsets) - 1) if len(owner) else np.zeros(0, int)
            for k in np.unique(size[size > 0]).tolist():
                chosen = size[owner] == k
                _, h = runs(hashes[chosen], owner[chosen], k)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(_slots(h, bits)))], names=["slot"])

    slots = shingles.select("shingle").mapInArrow(run, "slot long")
    word = F.shiftright("slot", 6)
    bit = F.expr("shiftleft(1L, cast(slot & 63 AS INT))")
    found = slots.groupBy(word.alias("word")).agg(F.bit_or(bit).alias("bits")).toPandas()
    out = np.zeros(bits // 64, dtype=np.int64)
    out[found["word"].to_numpy(dtype=np.int64)] = found["bits"].to_numpy(dtype=np.int64)
    return out.view(np.uint8)


def item_sketches(items: DataFrame, words: int = WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """(item, shingle, n, size_class, sketch) of items(id, t): n distinct shingles, and whether this one is in the sketch."""
    s = shingles_in(items, None, [words], whole_if_short=words).select(F.col("id").alias("item"), "shingle").distinct()
    shared = s.groupBy("shingle").agg(F.count(F.lit(1)).alias("items"))
    s = s.join(shared, "shingle")
    mine = Window.partitionBy("item")  # an item is a short test text
    s = s.withColumn("n", F.count(F.lit(1)).over(mine))
    s = s.withColumn("rank", F.row_number().over(mine.orderBy("items", F.xxhash64("shingle"), "shingle")))
    s = s.withColumn("size_class", F.floor(F.log2("n")).cast("int"))
    largest = F.pow(F.lit(2), F.col("size_class") + 1) - 1
    length = F.floor((1 - threshold) * largest + 1e-9) + 1
    return s.select("item", "shingle", "n", "size_class", (F.col("rank") <= length).alias("sketch"))


def contained_items(
    docs: DataFrame, items: DataFrame, id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text",
    words: int = WORDS, threshold: float = THRESHOLD, bits: int = BITS,
) -> DataFrame:
    """(id, item_id, shared, n, containment) for every item whose distinct shingles are in a document to `threshold` or more.

    Words are lower-cased and split at ASCII white space. An item of fewer than `words` words is one shingle, its
    whole sequence; items without words (NULL, empty) are in no document. Rows that repeat an id count as one
    document or item, as do rows with a NULL id. Empty tables give no rows; other columns are not read.
    """
    lower = lambda df, i, t: df.select(F.col(i).alias("id"), F.lower(text_of(t)).alias("t"))
    sketches = cut_lineage(item_sketches(lower(items, item_id, item_text), words, threshold))
    # an item's shingle has `words` words, or fewer if that is its whole text
    lengths = [r.k for r in sketches.select(F.size(F.split("shingle", " ")).alias("k")).distinct().orderBy("k").collect()]
    found = shingles_in(lower(docs, id, text), bit_table(sketches, bits), lengths)
    found = cut_lineage(found.join(sketches.select("shingle").distinct(), "shingle", "left_semi").distinct())
    pairs = found.join(sketches.where("sketch"), "shingle").select("id", "item").distinct()
    a, b, s = found.alias("a"), pairs.alias("b"), sketches.alias("s")
    both = a.join(b, F.col("a.id").eqNullSafe(F.col("b.id"))).join(
        s, F.col("b.item").eqNullSafe(F.col("s.item")) & (F.col("a.shingle") == F.col("s.shingle")))
    out = both.groupBy(F.col("b.id").alias("id"), F.col("b.item").alias("item"), F.col("s.n").alias("n")).agg(F.count(F.lit(1)).alias("shared"))
    out = out.where(F.col("shared") >= F.ceil(threshold * F.col("n") - 1e-9))
    return out.select(F.col("id").alias(id), F.col("item").alias(item_id), "shared", "n", (F.col("shared") / F.col("n")).alias("containment"))


def drop_contaminated(docs: DataFrame, items: DataFrame, id: str = "doc_id", **more) -> DataFrame:
    """docs without the documents that contain an item; all columns as they were."""
    hit = cut_lineage(contained_items(docs, items, id, **more).select(F.col(id).alias("hit")).distinct())
    return docs.join(hit, docs[id].eqNullSafe(hit["hit"]), "left_anti")
