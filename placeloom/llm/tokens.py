"""Token counts of whole texts, huge ones by overlapping chunks that are spliced where both sides provably agree.

Why a splice is exact. The tokenizer first scans the text from left to right into pre-tokens and then encodes each
pre-token alone. The scan has no memory: what follows a pre-token boundary depends on the text after it only. So
if a chunk that began on a known boundary and the next chunk, which began anywhere, both put a pre-token boundary
at position p, the next chunk's tokens from p on are those of the whole text. The first chunk's boundaries are
trusted up to `margin` characters before its cut end, because a pre-token there could look ahead, or an added
token could be cut in two. Where no common boundary exists the overlap is doubled, at most back to the last splice
(which is a common boundary by itself), and then the chunk is doubled, at most to the end of the text.
"""

from __future__ import annotations

import base64
import functools
import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from placeloom.llm.common import private, text_batches, text_of

HUGE = 32_768  # characters above which a text is encoded in chunks
CHUNK = 16_384
OVERLAP = 256

# Characters that every Unicode version puts into the same classes (letter, number, space, other): ASCII, Latin
# letters and signs, dashes and quotation marks. Other texts take the slower library.
_PLAIN = re.compile("[^\t\n\r\x20-\x7e¡-¬®-ɏ‐-‧‰-⁄]")


@functools.lru_cache(maxsize=4)
def load(name: str):
    """(tokenizers' Tokenizer, its added strings) of a public tokenizer file or a path; one per Python worker."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    import public_tokenizers
    from tokenizers import Tokenizer

    path = name if os.path.isabs(name) else public_tokenizers.path(name)
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    if (spec.get("pre_tokenizer") or {}).get("type") != "ByteLevel" or spec.get("normalizer") or spec["pre_tokenizer"].get("add_prefix_space"):
        raise ValueError(f"{name}: splicing is proven for byte-level tokenizers without normalizer or prefix space")
    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok, tuple(t["content"] for t in spec.get("added_tokens", []))


@functools.lru_cache(maxsize=4)
def load_ranks(name: str):
    """The same vocabulary as a table of ranks, where the public files have one; else None."""
    import public_tokenizers
    import tiktoken

    path = public_tokenizers.path(os.path.splitext(os.path.basename(name))[0] + ".tiktoken")
    if not os.path.exists(path):
        return None
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _bounds(tok, text: str, at: int, end: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Pre-token starts of text[at:end] as positions in the whole text, tokens before each, and all tokens."""
    e = tok.encode(text[at:end], add_special_tokens=False)
    words = np.array([-1 if w is None else w for w in e.word_ids], dtype=np.int64)
    spans = e.offsets
    starts = np.fromiter((s for s, _ in spans), dtype=np.int64, count=len(spans))
    first = np.flatnonzero(np.diff(words, prepend=-2) != 0)
    return starts[first] + at, first, len(words)


def count_spliced(tok, added: tuple[str, ...], text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Tokens of one text, holding the encoding of two chunks at most.

    Raises nothing for any text: the last resort is a chunk that reaches the end of the text.
    """
    n, margin = len(text), 2 + max([0, *map(len, added)])
    known = total = 0  # tokens before the boundary `known` are counted
    end = min(n, chunk)
    pos, before, count = _bounds(tok, text, 0, end)
    while end < n:
        width, back = chunk, max(overlap, margin + 1)
        while True:
            start = max(known, end - back)
            stop = min(n, start + max(width, end - start + chunk // 2))
            nxt, nxt_before, nxt_count = _bounds(tok, text, start, stop)
            common = np.intersect1d(pos[(pos > known) & (pos <= end - margin)], nxt, assume_unique=True)
            if len(common):
                break
            if start > known:
                back *= 2  # widen the overlap
                continue
            # the overlap reaches back to the last splice and still one pre-token fills the chunk: take a longer chunk
            end, width = stop, width * 2
            pos, before, count = nxt, nxt_before, nxt_count
            if end >= n:
                break
            back = max(overlap, margin + 1)
        if end >= n:
            break
        p = int(common[-1])
        total += int(before[np.searchsorted(pos, p)]) - int(before[np.searchsorted(pos, known)])
        known, pos, before, count, end = p, nxt, nxt_before, nxt_count, stop
    if not n:
        return 0
    return total + count - int(before[np.searchsorted(pos, known)])


def counts(texts: list[str], tokenizer: str, huge: int = HUGE, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[int]:
    tok, added = load(tokenizer)
    ranks = load_ranks(tokenizer)
    out, slow = [0] * len(texts), []
    for i, t in enumerate(texts):
        if len(t) > huge:
            out[i] = count_spliced(tok, added, t, chunk, overlap)
        elif ranks is None or _PLAIN.search(t) or any(a in t for a in added):
            slow.append(i)
        else:
            out[i] = len(ranks.encode_ordinary(t))
    for k in range(0, len(slow), 64):
        part = slow[k:k + 64]
        for i, e in zip(part, tok.encode_batch_fast([texts[i] for i in part], add_special_tokens=False)):
            out[i] = len(e)
    return out


def token_counts(
    docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", text: str = "text", limit: int = 512,
    huge: int = HUGE, chunk: int = CHUNK, overlap: int = OVERLAP,
) -> DataFrame:
    """All columns of docs with n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit).

    One narrow pass, no shuffle; a task holds one Arrow batch and, of a huge text, two encoded chunks. NULL and
    empty texts have 0 bytes and 0 tokens; repeated rows are counted each; an empty table gives no rows. Strings of
    special tokens inside a text become those tokens, the library's default. Existing columns of the three result
    names are replaced.
    """

    @F.pandas_udf("long")
    def n_tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series(counts(s.tolist(), tokenizer, huge, chunk, overlap), dtype="int64")

    tmp = private(docs, "n_tokens_")
    out = text_batches(docs).withColumn(tmp, n_tokens(text_of(text))).withColumn("n_bytes", F.octet_length(text_of(text)).cast("long"))
    return out.withColumn("n_tokens", F.col(tmp)).drop(tmp).withColumn("over_limit", F.col("n_tokens") > limit)
