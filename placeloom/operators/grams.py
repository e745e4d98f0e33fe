"""Which n-grams of a searched set occur in a text: one linear pass per text against a bit table of fixed size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

TABLE_BITS = 22  # 512 kB, whatever the number of n-grams; a full table lets more through, it never holds one back
PIECE = 1 << 20  # letters of a text looked at in one go
FLUSH = 1 << 18  # hits handed on at a time

_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def _fold(code: np.ndarray) -> np.ndarray:
    code = (code ^ (code >> np.uint64(32))) * _MIX
    return code ^ (code >> np.uint64(29))


def gram_codes(text: str, n: int, sizes: int = 1) -> list[np.ndarray]:
    """64-bit codes of all runs of n, 2n, 4n ... letters of a text in order, `sizes` lists that end where the text is too short.

    Equal runs have equal codes, others may share one. A code of twice the length is made of two of the shorter ones.
    """
    letters = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    count = len(letters) - n + 1
    if count < 1:
        return []
    code = letters[:count].copy()
    for i in range(1, n):
        code = code * _STEP + letters[i:i + count]
    out = [_fold(code)]
    while len(out) < sizes and len(out[-1]) > n:
        out.append(_fold(out[-1][:-n] * _STEP + out[-1][n:]))
        n *= 2
    return [c.view(np.int64) for c in out]


def _seats(codes: np.ndarray) -> np.ndarray:
    return codes.view(np.uint64) >> np.uint64(64 - TABLE_BITS)


def _distinct_codes(text: str, n: int, sizes: int = 1, table: np.ndarray | None = None) -> np.ndarray:
    """Distinct codes of a text that the table may hold; a long text goes through in pieces that share the longest run less one."""
    found = []
    reach = (n << (sizes - 1)) - 1
    for at in range(0, max(len(text) - n + 1, 0), PIECE):
        for codes in gram_codes(text[at:at + PIECE + reach], n, sizes):
            if table is not None:
                seat = _seats(codes)
                codes = codes[(table[seat >> np.uint64(6)] >> (seat & np.uint64(63))) & np.uint64(1) == 1]
            found.append(np.unique(codes))
    return np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)


def _longest_codes(text: str, n: int, sizes: int) -> np.ndarray:
    """Distinct codes of the longest size that fits into the text."""
    codes = gram_codes(text, n, sizes)
    return np.unique(codes[-1]) if codes else np.empty(0, np.int64)


def bit_table(codes: DataFrame, col: str = "gram") -> np.ndarray:
    """Bit table of the codes. The driver gets at most 2^16 words of it, put together by map-side combined ORs."""
    seat = F.shiftrightunsigned(col, 64 - TABLE_BITS)
    word = codes.groupBy(F.shiftright(seat, 6).alias("word")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), seat.bitwiseAND(F.lit(63)).cast("int"))).alias("bits"))
    table = np.zeros(1 << (TABLE_BITS - 6), np.int64)
    for row in word.collect():
        table[row["word"]] = row["bits"]
    return table.view(np.uint64)


def grams_in(
    rows: DataFrame, key: str, text: str, n: int, sizes: int = 1, table: np.ndarray | None = None, longest: bool = False
) -> DataFrame:
    """(key, gram): distinct codes of the runs of n, 2n, 4n ... (`sizes` lengths) letters of each row's text.

    With a bit table only codes that it may hold; with `longest` only those of the longest length that fits into the
    text, for the searched set. Texts that are NULL or shorter than n letters give no row. A row without a hit leaves
    nothing behind, and what a task holds is one batch of texts, one piece of a text and its hits.
    """
    frame = rows.select(key, text)
    kind = frame.schema[key].dataType

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at: list[int] = []
            codes: list[np.ndarray] = []
            held = 0

            def hand_on(batch=batch):
                ids = batch.column(0).take(pa.array(np.repeat(at, [len(c) for c in codes]), pa.int64()))
                return pa.RecordBatch.from_arrays([ids, pa.array(np.concatenate(codes))], names=[key, "gram"])

            for i, value in enumerate(batch.column(1)):
                body = value.as_py()
                if body is None:
                    continue
                hits = _longest_codes(body, n, sizes) if longest else _distinct_codes(body, n, sizes, table)
                if not len(hits):
                    continue
                at.append(i)
                codes.append(hits)
                held += len(hits)
                if held >= FLUSH:
                    yield hand_on()
                    at, codes, held = [], [], 0
            if held:
                yield hand_on()

    return frame.mapInArrow(scan, f"`{key}` {kind.simpleString()}, gram long")
