"""Quality scores from compression: one zstandard dictionary of good text, one of bad text.

A text is cut into blocks of `block` bytes, so that a dictionary helps along the whole text and not only at its
start. Each block is compressed with either dictionary; with the sums g and b the evidence is (b - g) / (b + g),
positive where the good dictionary helps more, and a logistic curve fitted on labelled rows outside the
dictionaries turns it into a probability of label 1.

Fitting uses a bounded sample: `per_class` labelled rows of each class, those with the smallest hash of the id,
and `sample_chars` characters of each. Scoring reads whole texts in one narrow pass.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from placeloom.llm.common import private, text_batches, text_of

PER_CLASS = 2000
SAMPLE_CHARS = 20_000
DICT_BYTES = 65_536
BLOCK = 1024
LEVEL = 1


@dataclass(frozen=True)
class Model:
    good: bytes
    bad: bytes
    slope: float
    intercept: float
    block: int = BLOCK
    level: int = LEVEL


@functools.lru_cache(maxsize=4)
def _compressors(model: Model):
    out = []
    for raw in (model.good, model.bad):
        d = zstandard.ZstdCompressionDict(raw)
        d.precompute_compress(level=model.level)
        out.append(zstandard.ZstdCompressor(level=model.level, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))
    return out


def evidence(model: Model, text: str) -> float:
    """(b - g) / (b + g) over all blocks; 0 for an empty text."""
    good, bad = _compressors(model)
    raw, g, b = text.encode("utf-8", "surrogatepass"), 0, 0
    for i in range(0, len(raw), model.block):
        part = raw[i:i + model.block]
        g += len(good.compress(part))
        b += len(bad.compress(part))
    return (b - g) / (b + g) if raw else 0.0


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-4) -> tuple[float, float]:
    """Slope and intercept of a weighted logistic fit on one variable by damped Newton steps."""
    scale = float(x.std()) or 1.0
    z, w = np.column_stack((x / scale, np.ones_like(x))), np.zeros(2)

    def loss(v):
        return float((weight * np.logaddexp(0, np.where(y == 1, -1, 1) * (z @ v))).sum() + ridge * v @ v / 2)

    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -500, 500)))
        grad = z.T @ (weight * (p - y)) + ridge * w
        step = np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + ridge * np.eye(2), grad)
        t = 1.0
        while loss(w - t * step) > loss(w) and t > 1e-6:
            t /= 2
        w = w - t * step
        if np.abs(t * step).max() < 1e-9:
            break
    return float(w[0] / scale), float(w[1])


def dictionary(texts: list[str], size: int, block: int) -> bytes:
    """A trained dictionary; the text itself where there is too little to train on."""
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    blocks = [r[i:i + block] for r in raw for i in range(0, len(r), block)]
    try:
        return zstandard.train_dictionary(min(size, max(1024, sum(map(len, blocks)) // 8)), blocks).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(blocks)[-size:]


def fit(
    docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "quality", use: Column | None = None,
    per_class: int = PER_CLASS, sample_chars: int = SAMPLE_CHARS, dict_bytes: int = DICT_BYTES, block: int = BLOCK, level: int = LEVEL,
) -> Model:
    """Model from the labelled rows for which `use` (a condition on labels' columns) holds.

    An id with two different labels is left out, as are NULL labels and ids. The curve is weighted to the classes'
    shares among all labelled rows. With rows of one class only, or none, the model gives every text the smoothed
    share of label 1.
    """
    known = labels if use is None else labels.where(use)
    known = known.where(F.col(id).isNotNull() & F.col(label).isin(0, 1)).groupBy(F.col(id).alias("id")).agg(
        F.min(label).alias("y"), F.max(label).alias("z")).where("y = z").select("id", "y")
    share = {r.y: r.n for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}  # two rows
    n0, n1 = share.get(0, 0), share.get(1, 0)
    prior = Model(b"", b"", 0.0, math.log((n1 + 1) / (n0 + 1)), block, level)
    if not n0 or not n1:
        return prior
    key = F.xxhash64(F.col("id").cast("string"))
    picked = [known.where(F.col("y") == y).orderBy(key, "id").limit(per_class) for y in (0, 1)]
    picked = picked[0].unionByName(picked[1])
    own = docs.select(F.col(id).alias("id"), F.substring(text_of(text), 1, sample_chars).alias("t"))
    # at most 2 * per_class ids are sent to the tasks, and as many texts of sample_chars come back
    rows = own.join(F.broadcast(picked), "id").groupBy("id", "y").agg(F.min("t").alias("t")).orderBy("id").collect()
    sides = {0: ([], []), 1: ([], [])}
    for n, r in enumerate(sorted(rows, key=lambda r: (r.y, r.id))):
        sides[r.y][n % 3 == 2].append(r.t)  # every third row is for the curve
    if not all(any(t) for side in sides.values() for t in side):
        return prior
    model = Model(dictionary(sides[1][0], dict_bytes, block), dictionary(sides[0][0], dict_bytes, block), 0.0, 0.0, block, level)
    x = np.array([evidence(model, t) for y in (0, 1) for t in sides[y][1]])
    y = np.repeat([0, 1], [len(sides[0][1]), len(sides[1][1])])
    weight = np.where(y == 1, n1 / len(sides[1][1]), n0 / len(sides[0][1]))
    slope, intercept = logistic(x, y, weight * len(y) / weight.sum())
    return Model(model.good, model.bad, slope, intercept, block, level)


def scored(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with score (0 to 1) and predicted (1 if score >= 0.5); existing columns of these names are replaced.

    NULL and empty texts have no evidence and get the curve's value at 0; equal texts get equal scores.
    """

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            x = np.array([evidence(model, t) for t in s]) if model.good else np.zeros(len(s))
            yield pd.Series(1 / (1 + np.exp(-np.clip(model.slope * x + model.intercept, -500, 500))))

    tmp = private(docs, "score_")
    out = text_batches(docs).withColumn(tmp, score(text_of(text))).withColumn("score", F.col(tmp)).drop(tmp)
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_good(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of docs that the model does not reject, with their columns as they were."""
    whole = docs.select(F.struct(*docs.columns).alias("row"), text_of(text).alias("t"))
    return scored(whole, model, "t").where(F.col("predicted") == 1).select("row.*")
