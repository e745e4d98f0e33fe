"""Substring dedup: words covered by windows of `WINDOW` words that an earlier document has as well are removed.

Texts are packed into compressed blocks. First pass: each block counts its windows as a sparse count-min sketch, cut into
slices by the windows' hashes; a slice's sketches are merged into `ROWS` rows of counters, four counters a window, whose
minimum overestimates each count, and the block is told which of its windows may occur twice. Second pass: only those
are grouped exactly, by 128-bit hashes, for the smallest document of each window; a window that occurs twice is never
among the others. A block sends each of its windows once, so a passage that every document has costs a slice one entry a block.

A task holds one block, or one slice of about `SLICE` windows; the number of slices follows the number of windows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, functions as F

from placeloom.llm.common import cut_lineage, drop_step, text_of

WINDOW = 13
BLOCK = 4 << 20  # bytes of text in a block, unless one text alone has more
SLICE = 1 << 20  # windows of a slice
ROWS, LOAD = 3, 4  # rows of a sketch, counters a window
KEY = 28  # bits of a window's key in its slice
_U = np.uint64
_MIX = np.array([[xxhash.xxh64_intdigest(f"{lane}:{i}") | 1 for i in range(WINDOW + 1)] for lane in (0, 1)], dtype=np.uint64)
_ROW = np.array([xxhash.xxh64_intdigest(f"row:{i}") | 1 for i in range(ROWS)], dtype=np.uint64)
NO_DOC = np.iinfo(np.int64).max
_ZERO = np.uint32(0)


def _shut(x: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(x)


def _open(x: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(x)


def pack(ids: list[int | None], texts: list[bytes]) -> bytes:
    head = [np.array([len(ids)]), np.array([i is None for i in ids]), np.array([i or 0 for i in ids]), np.array([len(t) for t in texts])]
    return _shut(b"".join([x.astype("<i8").tobytes() for x in head] + texts))


def unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """(ids, which of them are NULL, texts)."""
    raw = _open(blob)
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    null, ids, size = np.frombuffer(raw, "<i8", 3 * n, 8).reshape(3, n)
    ends = np.cumsum(size) + 8 + 24 * n
    return ids, null != 0, [raw[e - s:e] for e, s in zip(ends.tolist(), size.tolist())]


class Windows:
    """Words of a block and the 128-bit hashes of its windows; windows never cross documents, rows without an id have none."""

    def __init__(self, blob: bytes):
        self.ids, null, texts = unpack(blob)
        split = [t.split() for t in texts]  # bytes: at ASCII white space only
        self.words = [w for ws in split for w in ws]
        self.sizes = np.array([len(ws) for ws in split], dtype=np.int64)
        number = {w: i for i, w in enumerate(dict.fromkeys(self.words))}
        code = np.fromiter(map(number.__getitem__, self.words), dtype=np.int64, count=len(self.words))
        word = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, number)), dtype="<u8").reshape(-1, 2)
        n = max(len(code) - WINDOW + 1, 0)
        doc = np.repeat(np.arange(len(self.sizes)), self.sizes)
        inside = doc[:n] == doc[WINDOW - 1:] if n else np.zeros(0, dtype=bool)
        self.start = np.flatnonzero(inside & ~null[doc[:n]])
        self.doc = self.ids[doc[self.start]]
        self.h = np.zeros((2, len(self.start)), dtype=np.uint64)
        for lane in (0, 1):
            a, h = word[code, lane], np.zeros(n, dtype=np.uint64)
            for i in range(WINDOW):
                h ^= h >> _U(29)
                h *= _MIX[lane, i]
                h += a[i:i + n]
            h ^= h >> _U(32)
            h *= _MIX[lane, WINDOW]
            h ^= h >> _U(29)
            self.h[lane] = h[self.start]

    def keyed(self, slices: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(slice and key, in one number in order; its window of each; how often each)."""
        h = self.h[0]
        both = ((h >> _U(KEY)) % _U(slices) << _U(KEY)) | (h & _U((1 << KEY) - 1))
        return np.unique(both, return_inverse=True, return_counts=True)

    def suspects(self, slices: int, maybe: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Windows whose key is marked: (their places, hash columns in order, hash of each place, smallest document of each hash)."""
        at = np.flatnonzero(maybe[self.keyed(slices)[1]])
        h0, h1 = self.h[:, at]
        order = np.lexsort((h1, h0))
        a, b = h0[order], h1[order]
        new = np.ones(len(order), dtype=bool)
        new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        which = np.empty(len(order), dtype=np.int64)
        which[order] = np.cumsum(new) - 1
        least = np.full(int(new.sum()), NO_DOC)
        np.minimum.at(least, which, self.doc[at])
        return at, np.stack((a[new], b[new])), which, least


def _cut(slice_of: np.ndarray) -> list[tuple[int, int, int]]:
    """(slice, from, to) of the runs of equal slices."""
    if not len(slice_of):
        return []
    cuts = [0, *(np.flatnonzero(slice_of[1:] != slice_of[:-1]) + 1).tolist(), len(slice_of)]
    return [(int(slice_of[x]), x, y) for x, y in zip(cuts, cuts[1:])]


def estimate(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Count-min estimate of each key from the counters that all keys and counts were added to; never below the true sum."""
    bits = max(6, int(LOAD * len(keys) - 1).bit_length())
    least = np.full(len(keys), np.inf)
    for m in _ROW:
        cell = ((keys.astype(np.uint64) * m) >> _U(64 - bits)).astype(np.int64)
        least = np.minimum(least, np.bincount(cell, weights=counts)[cell])
    return least


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """One row at a time, so that a worker unpacks one block at a time."""
    for b in batches:
        for k in range(b.num_rows):
            yield b.slice(k, 1).to_pylist()[0]


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[dict]]]:
    """Rows of each slice; the input is in order of slices."""
    held: list[dict] = []
    for r in _rows(batches):
        if held and held[0]["slice"] != r["slice"]:
            yield held[0]["slice"], held
            held = []
        held.append(r)
    if held:
        yield held[0]["slice"], held


def blocks(docs: DataFrame, size: int = BLOCK, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(block, n_words, blob) with all texts, stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, held = [], [], 0

        def flush():
            n = sum(len(t.split()) for t in texts)
            return pa.RecordBatch.from_pydict({"n_words": pa.array([n], pa.int64()), "blob": pa.array([pack(ids, texts)], pa.binary())})

        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1)):
                own = t.as_py()
                if texts and held + len(own) > size:
                    yield flush()
                    ids, texts, held = [], [], 0
                ids.append(i)
                texts.append(own)
                held += len(own)
        if texts:
            yield flush()

    own = docs.select(F.col(id).cast("long").alias("id"), text_of(text).cast("binary").alias("text"))
    return cut_lineage(own.mapInArrow(run, "n_words long, blob binary").withColumn("block", F.monotonically_increasing_id()))


def _by_slice(rows: DataFrame, slices: int) -> DataFrame:
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(max(parts, min(slices, 8 * parts)), "slice").sortWithinPartitions("slice", "block")


def _answers(rows: DataFrame, name: str) -> DataFrame:
    """What all slices say to a block, in order of slices; as long as the block's own windows at most."""
    said = rows.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("slice", "said"))).alias("s"))
    return said.select("block", F.col("s.said").alias(name))


def _marks(said: list[bytes], slices: list[tuple[int, int, int]], n: int) -> np.ndarray:
    maybe = np.zeros(n, dtype=bool)
    for part, (_, x, y) in zip(said, slices, strict=True):
        maybe[x:y] = np.unpackbits(np.frombuffer(part, np.uint8), count=y - x).astype(bool)
    return maybe


def repeated(packed: DataFrame, slices: int) -> DataFrame:
    """(block, maybe): for every block, which of its keys the merged sketches hold for repeated."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for block, blob in zip(b.column("block").to_pylist(), b.column("blob")):
                both, _, n = Windows(blob.as_py()).keyed(slices)
                key, cuts = (both & _U((1 << KEY) - 1)).astype("<u4"), _cut(both >> _U(KEY))
                step = [_shut(np.diff(key[x:y], prepend=_ZERO).tobytes()) for _, x, y in cuts]
                twice = [_shut(np.packbits(n[x:y] > 1).tobytes()) for _, x, y in cuts]
                yield pa.RecordBatch.from_pydict({"slice": pa.array([s for s, _, _ in cuts], pa.int32()), "block": pa.array([block] * len(cuts), pa.int64()),
                                                  "keys": pa.array(step, pa.binary()), "twice": pa.array(twice, pa.binary())})

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _slices(batches):
            keys = [np.cumsum(np.frombuffer(_open(r["keys"]), "<u4"), dtype=np.uint32) for r in rows]
            counts = [1 + np.unpackbits(np.frombuffer(_open(r["twice"]), np.uint8), count=len(k)) for r, k in zip(rows, keys)]
            over = estimate(np.concatenate(keys), np.concatenate(counts)) >= 2
            ends = np.cumsum([len(k) for k in keys])
            said = [np.packbits(over[e - len(k):e]).tobytes() for e, k in zip(ends.tolist(), keys)]
            yield pa.RecordBatch.from_pydict({"slice": pa.array([r["slice"] for r in rows], pa.int32()), "block": pa.array([r["block"] for r in rows], pa.int64()),
                                              "said": pa.array(said, pa.binary())})

    sent = packed.select("block", "blob").mapInArrow(sketch, "slice int, block long, keys binary, twice binary")
    return _answers(_by_slice(sent, slices).mapInArrow(merge, "slice int, block long, said binary"), "maybe")


def firsts(told: DataFrame, slices: int) -> DataFrame:
    """(block, first): for every hash of a block's suspects, in order, the smallest document that has the window."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _rows(batches):
            w = Windows(r["blob"])
            both = w.keyed(slices)[0]
            _, h, _, least = w.suspects(slices, _marks(r["maybe"] or [], _cut(both >> _U(KEY)), len(both)))
            cuts = _cut((h[0] >> _U(32)) * _U(slices) >> _U(32))
            yield pa.RecordBatch.from_pydict({
                "slice": pa.array([s for s, _, _ in cuts], pa.int32()), "block": pa.array([r["block"]] * len(cuts), pa.int64()),
                "hashes": pa.array([h[:, x:y].tobytes() for _, x, y in cuts], pa.binary()), "least": pa.array([_shut(least[x:y].tobytes()) for _, x, y in cuts], pa.binary())})

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _slices(batches):
            h = [np.frombuffer(r["hashes"], "<u8").reshape(2, -1) for r in rows]
            a, b = np.concatenate(h, axis=1)
            least = np.concatenate([np.frombuffer(_open(r["least"]), "<i8") for r in rows])
            order = np.lexsort((least, b, a))
            new = np.ones(len(order), dtype=bool)
            new[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
            first = np.empty(len(order), dtype=np.int64)
            first[order] = least[order][new][np.cumsum(new) - 1]
            ends = np.cumsum([x.shape[1] for x in h])
            said = [_shut(first[e - x.shape[1]:e].tobytes()) for e, x in zip(ends.tolist(), h)]
            yield pa.RecordBatch.from_pydict({"slice": pa.array([r["slice"] for r in rows], pa.int32()), "block": pa.array([r["block"] for r in rows], pa.int64()),
                                              "said": pa.array(said, pa.binary())})

    sent = told.mapInArrow(send, "slice int, block long, hashes binary, least binary")
    return _answers(_by_slice(sent, slices).mapInArrow(group, "slice int, block long, said binary"), "first")


def dedup(docs: DataFrame, id: str = "doc_id", text: str = "text", size: int = BLOCK, slice: int = SLICE) -> DataFrame:
    """(doc_id, n_words, n_removed, kept) of every row; kept is the text that stays, words joined by one space.

    Words are runs of anything but ASCII white space. A word goes if a window over it also starts in a document with a
    smaller id, in the text as given. NULL and empty texts have no words; rows that repeat an id do not remove each other's
    windows; a row without an id neither removes nor loses words. Other columns of docs are not read.
    """
    packed = blocks(docs, size, id, text)
    words = packed.agg(F.sum("n_words")).head()[0] or 0
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slices = max(2 * parts, -(-words // slice))
    maybe = cut_lineage(repeated(packed, slices))
    told = packed.select("block", "blob").join(maybe, "block", "left")
    first = cut_lineage(firsts(told, slices).join(maybe, "block"))
    drop_step(maybe)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in _rows(batches):
            yield _cleaned(r, slices)

    return packed.select("block", "blob").join(first, "block", "left").mapInArrow(clean, "doc_id long, n_words long, n_removed long, kept string")


def _cleaned(r: dict, slices: int) -> pa.RecordBatch:
    w = Windows(r["blob"])
    both = w.keyed(slices)[0]
    at, _, which, _ = w.suspects(slices, _marks(r["maybe"] or [], _cut(both >> _U(KEY)), len(both)))
    first = np.concatenate([np.frombuffer(_open(x), "<i8") for x in r["first"] or []] or [np.zeros(0, dtype=np.int64)])
    start = w.start[at[w.doc[at] > first[which]]] if len(at) else at
    cover = np.zeros(len(w.words) + 1, dtype=np.int64)
    cover[start] += 1
    cover[start + WINDOW] -= 1
    keep = np.cumsum(cover)[:-1] == 0
    kept, removed, x = [], [], 0
    for n in w.sizes.tolist():
        stays = keep[x:x + n]
        kept.append(b" ".join([w.words[x + i] for i in np.flatnonzero(stays).tolist()]))
        removed.append(n - int(stays.sum()))
        x += n
    _, null, _ = unpack(r["blob"])
    return pa.RecordBatch.from_pydict({
        "doc_id": pa.array(w.ids, pa.int64(), mask=null), "n_words": w.sizes, "n_removed": pa.array(removed, pa.int64()),
        "kept": pa.array([k.decode("utf-8", "replace") for k in kept], pa.string())})
