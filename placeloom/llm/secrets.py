"""Secrets in texts: fixed patterns, and character Markov models of random strings against ordinary identifiers.

The patterns find assignments (password = ...), access keys and long hex strings. Two character chains score the other
tokens of 16 or more characters: one trained on random strings, one on ordinary identifiers, paths and file names, from the labelled samples of
tokensamples.py. The ordinary chain also learns, with equal weight, from all tokens of the corpus outside the patterns' matches, so that its
languages are not strange to it.

A chain is in two parts: which class of character follows the two classes before (lower, upper, digit, each sign), and which letter follows the
letter before, without case, a capital after a small letter starting anew. A token is reported if its log-likelihood ratio is over the
threshold, which is half way between what all but `FALSE` of the ordinary samples of another seed, made of other words, stay under and what all
but `MISSED` of that seed's random ones exceed. If a whole
token is not, its parts between slashes and equals signs are tried. UUIDs are ordinary by their form, as are tokens of few different characters.

Training counts cover all documents: they are sums over classes and letter pairs, added up in tasks and then by
Spark, so what reaches the driver is one table of fixed size whatever the corpus.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from placeloom.llm.common import text_batches, text_of
from placeloom.llm.tokensamples import WORDS, ordinary_tokens, random_tokens

# The patterns and lengths of the base kinds, in the order in which kinds are listed.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # the runs of 24 or more, the same spans as all runs without the shorter ones
KINDS = ("assign", "access", "hex", "markov")
VALUE, KEY = 6, 20  # least characters of an assigned value, of an access key

_HINTS = ("passw", "secret", "token", "apikey", "api_key")  # one must occur for the slow assignment pattern to match
SHORTEST, DIFFERENT = 16, 7  # least characters of a candidate, and least different ones
_LONG = re.compile(rf"[A-Za-z0-9+/_=-]{{{SHORTEST},}}")  # candidates of the models; every long hex string lies in one
_PART = re.compile(rf"[A-Za-z0-9+_-]{{{SHORTEST},}}")
_UUID = re.compile(r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
_LETTER = re.compile(r"[A-Za-z]")

SAMPLES, FALSE, MISSED, SMOOTH = 20_000, 0.001, 0.01, 40  # samples of each class; shares of ordinary ones over the threshold, of random ones under it
_CLASS, _LETTERS = np.zeros(256, dtype=np.int64), np.zeros(256, dtype=np.int64)  # class 0: any other character; letter 0: none
for _i, _set in enumerate(("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "+", "/", "_", "=", "-")):
    _CLASS[list(_set.encode())] = _i + 1
for _i in range(26):
    _LETTERS[[97 + _i, 65 + _i]] = _i + 1
CLASSES, LETTERS = 9, 27
SIZE = CLASSES**3 + LETTERS**2  # cells of a table of counts: class triples, then letter pairs


def base_spans(text: str, long: list[re.Match] | None = None) -> list[tuple[int, int, int]]:
    """(kind number, start, end) of the fixed patterns, leftmost and not overlapping within a kind."""
    out, low = [], text.lower()
    if any(h in low for h in _HINTS):
        out += [(0, *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= VALUE]
    if "AKIA" in text:
        out += [(1, *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= KEY]
    for t in _LONG.finditer(text) if long is None else long:
        out += [(2, *m.span()) for m in HEX.finditer(text, t.start(), t.end())]
    return out


def _cells(raw: bytes) -> np.ndarray:
    """The cells of SIZE that the characters of the tokens in raw fall into; tokens begin in class 0 and letter 0."""
    data = np.frombuffer(b"  " + raw, dtype=np.uint8)
    c, letter = _CLASS[data], _LETTERS[data]
    two, one, now = c[:-2], c[1:-1], c[2:]
    triple = (np.where(one > 0, two, 0) * CLASSES + one) * CLASSES + now
    before = np.where((one == 1) & (now == 2), 0, letter[1:-1])
    pair = CLASSES**3 + before * LETTERS + letter[2:]
    return np.concatenate([triple[now > 0], pair[letter[2:] > 0]])


def _pairs(raw: bytes) -> np.ndarray:
    return np.bincount(_cells(raw), minlength=SIZE)


def training_counts(text: str) -> np.ndarray:
    """Counts of the tokens of one text outside the fixed patterns."""
    rest, at = [], 0
    for s, e in sorted((s, e) for _, s, e in base_spans(text)):
        rest.append(text[at:max(at, s)])
        at = max(at, e)
    return _pairs(" ".join([*rest, text[at:]]).encode("utf-8", "surrogatepass"))


@dataclass(frozen=True)
class Model:
    """Log-likelihood ratio, random over ordinary, of each cell, and the ratio from which a token is reported."""

    ratio: np.ndarray
    threshold: float

    def score(self, token: str) -> float:
        return float(self.ratio[_cells(token.encode("ascii"))].sum())

    def random(self, token: str) -> bool:
        return len(set(token)) >= DIFFERENT and bool(_LETTER.search(token)) and not _UUID.search(token) and self.score(token) > self.threshold


def _chain(counts: np.ndarray, width: int) -> np.ndarray:
    """log P(next | state) of a table with `width` nexts a state, smoothed towards P(next); next 0 does not occur."""
    counts = counts.reshape(-1, width).astype(float)
    share = counts.sum(axis=0) + 0.5
    share[0] = 0
    p = (counts + SMOOTH * share / share.sum()) / (counts.sum(axis=1, keepdims=True) + SMOOTH)
    p[:, 0] = 1
    return np.log(p).ravel()


def _both(counts: np.ndarray) -> np.ndarray:
    return np.concatenate([_chain(counts[:CLASSES**3], CLASSES), _chain(counts[CLASSES**3:], LETTERS)])


def model_of(corpus: np.ndarray, seed: int = 1, samples: int = SAMPLES, false: float = FALSE, missed: float = MISSED) -> Model:
    """Model from the samples of `seed` and the counts of the corpus; the threshold from those of `seed + 1`."""
    counts = lambda tokens: _pairs(" ".join(tokens).encode()).astype(float)
    ordinary = counts(ordinary_tokens(seed, samples, WORDS[::2]))
    ordinary += corpus * (ordinary.sum() / max(corpus.sum(), ordinary.sum()))
    model = Model(_both(counts(random_tokens(seed, samples))) - _both(ordinary), 0.0)
    score = lambda tokens: [model.score(t) for t in tokens]
    ordinary, random = score(ordinary_tokens(seed + 1, samples, WORDS[1::2])), score(random_tokens(seed + 1, samples))
    return Model(model.ratio, float(np.quantile(ordinary, 1 - false) + np.quantile(random, missed)) / 2)


def fit(docs: DataFrame, text: str = "text") -> Model:
    """Model with the counts over all rows of docs; the driver gets SIZE rows at most."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros(SIZE, dtype=np.int64)
        for pdf in batches:
            for t in pdf["t"]:
                counts += training_counts(t)
        used = np.flatnonzero(counts)
        yield pd.DataFrame({"cell": used, "n": counts[used]})

    counts = text_batches(docs).select(text_of(text).alias("t")).mapInPandas(run, "cell long, n long")
    corpus = np.zeros(SIZE)
    for r in counts.groupBy("cell").agg(F.sum("n").alias("n")).collect():
        corpus[r.cell] = r.n
    return model_of(corpus)


def find(text: str, model: Model) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Spans of the fixed patterns, and those that the models add; each sorted by start, then kind."""
    long = list(_LONG.finditer(text))
    base = sorted(base_spans(text, long), key=lambda s: (s[1], s[0], s[2]))
    added = []
    for m in long:
        if any(s < m.end() and m.start() < e for _, s, e in base):
            continue
        if model.random(m[0]):
            added.append((3, *m.span()))
        else:
            added += [(3, *p.span()) for p in _PART.finditer(text, *m.span()) if p.span() != m.span() and model.random(p[0])]
    return base, added


def _written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


def secrets(docs: DataFrame, model: Model, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_assign, n_access, n_hex, base_sha256, spans) for every row of docs.

    Positions are code points, ends exclusive. NULL and empty texts have no spans, counts of 0 and the digest of the
    empty string; repeated rows come out each; an empty table gives no rows; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for t in batch.column("t").to_pylist():
                base, added = find(t, model)
                n = [sum(k == i for k, _, _ in base) for i in range(3)]
                everything = sorted(base + added, key=lambda s: (s[1], s[0], s[2]))
                rows.append((*n, hashlib.sha256(_written(base).encode()).hexdigest(), _written(everything)))
            kinds = [pa.int64()] * 3 + [pa.string()] * 2
            found = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *found], names=["id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])

    own = text_batches(docs).select(F.col(id).alias("id"), text_of(text).alias("t"))
    schema = own.select("id").schema
    for c in ("n_assign", "n_access", "n_hex"):
        schema = schema.add(c, "long")
    return own.mapInArrow(run, schema.add("base_sha256", "string").add("spans", "string")).withColumnRenamed("id", id)
