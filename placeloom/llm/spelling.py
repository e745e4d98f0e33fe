"""Spelling variants: words of a corpus, their near words at one edit, and the far commoner form each one stands for.

Near words are found by FM-index search schemes (`fmindex`). One edit leaves the left or the right half of a word as
it is, so a word is searched only among the words with the same left half (cells of side P) and those with the same right
half (side S). Cells are dealt into slots of about `SLOT` words, each indexed in one task; a cell of more words is dealt
out by the words' hashes, and its queries go to each of its slots. A task holds one slot's index and a batch of queries.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from placeloom.llm.common import cut_lineage, drop_step
from placeloom.llm.fmindex import Index, near
from placeloom.operators.scale import skew_join

LETTERS = "[A-Za-zÀ-ÿ]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LEAST_LENGTH, LEAST_COUNT = 5, 3
TIMES = 2  # a form is at least so many times as frequent
SLIPS = 97  # one run in so many loses a code point
SLOT = 32_768  # words of one index


def slipped(run: Column, id: Column) -> Column:
    """The run without its code point h % length, if SLIPS divides h = crc32 of '<id>:<run>' (NULL id: empty)."""
    h = F.crc32(F.concat(F.coalesce(id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.char_length(run)).cast("int")
    return F.when(h % SLIPS == 0, F.concat(F.substring(run, F.lit(1), at), F.substring(run, at + 2, F.char_length(run)))).otherwise(run)


def vocabulary(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """(word, n): results of at least LEAST_LENGTH code points and LEAST_COUNT occurrences over whole texts."""
    runs = docs.select(F.col(id).alias("id"), F.explode(F.regexp_extract_all(F.translate(text, UPPER, UPPER.lower()), F.lit(LETTERS), F.lit(0))).alias("run"))
    words = runs.where(F.char_length("run") >= LEAST_LENGTH).select(slipped(F.col("run"), F.col("id")).alias("word"))
    counts = words.where(F.char_length("word") >= LEAST_LENGTH).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counts.where(F.col("n") >= LEAST_COUNT)


def _keys(side: str, lengths: list[Column]) -> Column:
    """Cell keys of a word for queries of the given lengths: its left (P) or right (S) half as such a query would cut it."""
    halves = [(F.floor(m / 2) if side == "P" else F.ceil(m / 2)).cast("int") for m in lengths]
    own = F.char_length("word")
    parts = [F.substring("word", F.lit(1) if side == "P" else own - k + 1, k) for k in halves]
    return F.array_distinct(F.array(*[F.xxhash64(F.lit(side), k, p) for k, p in zip(halves, parts)]))


def _cells(words: DataFrame, lengths: list[Column]) -> DataFrame:
    sides = F.array(*[F.struct(F.lit(s == "P").alias("first"), _keys(s, lengths).alias("cells")) for s in "PS"])
    out = words.withColumn("side", F.explode(sides))
    return out.select("word", "n", "mix", "side.first", F.explode("side.cells").alias("cell"))


def _slots(words: DataFrame, slot: int) -> DataFrame:
    """Index rows and query rows of each slot."""
    m, parts = F.char_length("word"), int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    words = words.withColumn("mix", F.pmod(F.xxhash64("word"), F.lit(1 << 30)).cast("int"))
    index, queries = _cells(words, [m - 1, m, m + 1]), _cells(words, [m])
    size = index.groupBy("cell").agg(F.count(F.lit(1)).alias("rows"))
    size = cut_lineage(size.join(queries.select("cell").distinct(), "cell", "left_semi"))  # cells without a query are not built
    rows = size.agg(F.sum("rows")).head()[0] or 0
    slots = max(4 * parts, -(-rows // slot))
    hot = size.where(F.col("rows") > slot).select("cell", F.ceil(F.col("rows") / slot).cast("int").alias("g"))
    g = F.coalesce(F.col("g"), F.lit(1))
    at = F.pmod(F.xxhash64("cell", "salt"), F.lit(slots)).cast("int")
    index = index.join(size.select("cell"), "cell", "left_semi").join(hot, "cell", "left").withColumn("salt", F.pmod("mix", g).cast("int"))
    queries = queries.join(hot, "cell", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), g - 1)))
    both = [df.select(at.alias("slot"), F.lit(kind).alias("kind"), "first", "word", "n", "mix", g.alias("g"), "salt") for kind, df in enumerate((index, queries))]
    return both[0].unionByName(both[1]).repartition(parts, "slot").sortWithinPartitions("slot", "kind")


FOUND = "word string, n_near long, best_n long, best string"


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Near words of each query row in its slot: how many, and the one of largest n (ties: the smallest)."""
    slot, held, built = None, [], None

    def build():
        words = pa.Table.from_batches(held).select(["word", "n", "mix"]).to_pydict()
        own = {w: (n, m) for w, n, m in zip(words["word"], words["n"], words["mix"])}
        order = sorted(own)
        n, mix = np.array([own[w] for w in order], dtype=np.int64).reshape(-1, 2).T
        return Index(order), n, mix

    for b in batches:
        at, kind = b.column("slot").to_numpy(), b.column("kind").to_numpy()
        cuts = [0, *(np.flatnonzero((at[1:] != at[:-1]) | (kind[1:] != kind[:-1])) + 1).tolist(), len(at)]
        for x, y in zip(cuts, cuts[1:]):
            if x == y:
                continue
            if at[x] != slot:
                slot, held, built = at[x], [], None
            part = b.slice(x, y - x)
            if kind[x] == 0:
                held.append(part)
                continue
            if not held:
                continue
            if built is None:
                built, held = build(), [True]
            index, n, mix = built
            first = part.column("first").to_numpy(zero_copy_only=False)
            g, salt = part.column("g").to_numpy(), part.column("salt").to_numpy()
            for side in (True, False):
                rows = np.flatnonzero(first == side)
                if not len(rows):
                    continue
                words = part.column("word").take(pa.array(rows)).to_pylist()
                i, j = near(index, words, side)
                keep = mix[j] % g[rows[i]] == salt[rows[i]]  # of a cell in several slots, each slot answers for its own words
                i, j = i[keep], j[keep]
                if not len(i):
                    continue
                order = np.lexsort((j, -n[j], i))
                i, j = i[order], j[order]
                head = np.flatnonzero(np.concatenate(([True], i[1:] != i[:-1])))
                yield pa.RecordBatch.from_pydict({
                    "word": pa.array([words[k] for k in i[head].tolist()], pa.string()), "n_near": np.diff(np.append(head, len(i))),
                    "best_n": n[j[head]], "best": pa.array([index.words[k] for k in j[head].tolist()], pa.string())})


def near_words(words: DataFrame, slot: int = SLOT) -> DataFrame:
    """(word, n_near, best_n, best) of the words(word, n) that have near words; words are distinct."""
    found = _slots(words, slot).mapInArrow(_search, FOUND)
    per = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("less"), "best")).alias("b"))
    return per.select("word", "n_near", (-F.col("b.less")).alias("best_n"), F.col("b.best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for forms(word, form): the last word of each chain, by pointer jumping. Chains rise in n, so they end."""
    up = cut_lineage(forms.select("word", F.col("form").alias("root")))
    while True:
        over = up.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = skew_join(up, over, ["root"], "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        older, step = up, cut_lineage(step)
        drop_step(older)
        if step.where("moved").isEmpty():
            return step.select("word", "root")
        up = step


def variants(docs: DataFrame, id: str = "doc_id", text: str = "text", slot: int = SLOT) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of the corpus.

    NULL and empty texts have no words, an empty table gives no rows; texts and words may be of any length. Rows that
    repeat count each. Other columns of docs are not read.
    """
    words = cut_lineage(vocabulary(docs, id, text))
    found = near_words(words, slot)
    form = F.when(F.col("best_n") >= TIMES * F.col("n"), F.col("best"))
    dealt = words.join(found, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), form.alias("form"), F.when(form.isNotNull(), F.col("best_n")).alias("form_n"))
    dealt = cut_lineage(dealt)
    drop_step(words)
    top = roots(dealt.where("form IS NOT NULL"))
    out = dealt.join(top, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
