"""Skew-safe joins and numbering used by the other operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from placeloom.session import cut_lineage

HOT_ROWS = 1_000_000  # rows of one key above which a numbering is spread over several tasks


def hot_keys(df: DataFrame, keys: list[str], hot_rows: int) -> DataFrame | None:
    """(keys, _salts) of the keys with more than `hot_rows` rows, None when there is none.

    One map-side combined count; the result has at most rows / hot_rows entries.
    """
    hot = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > hot_rows)
    hot = hot.select(*keys, F.ceil(F.col("_n") / hot_rows).cast("int").alias("_salts"))
    return None if hot.isEmpty() else cut_lineage(hot)


def skew_join(
    big: DataFrame, other: DataFrame, keys: list[str], how: str = "inner", hot_rows: int | None = None, grown: bool = False
) -> DataFrame:
    """Equi-join (inner, left, left_semi, left_anti) that stands a hot key in `big`.

    Spark splits a hot key's partitions of `big` at run time by their real size (skew join handling, forced in
    build_session), whatever join strategy the sizes call for. With `hot_rows` given, keys with more rows are salted
    instead: `big` rows of a hot key are dealt out over salts by their place in the input, so equal rows part too, and
    `other` rows of it are repeated once per salt.

    `grown` says that rows of a side were multiplied below (cells, pieces). Spark's size estimate does not see that and would
    send a table of many times the broadcast limit through the driver, so such a join is always a sort-merge join.
    """
    def plain(df):
        return df.hint("merge") if grown else df

    hot = None if hot_rows is None else hot_keys(big, keys, hot_rows)
    if hot is None:
        return plain(big).join(plain(other), keys, how)
    hot = hot.select(*[F.col(k).alias(f"_h_{k}") for k in keys], "_salts")

    def with_salts(df):
        cond = [F.col(k) == F.col(f"_h_{k}") for k in keys]
        return df.join(hot, cond, "left").drop(*[f"_h_{k}" for k in keys])  # Spark broadcasts it by its real size

    salts = F.coalesce(F.col("_salts"), F.lit(1))
    left = with_salts(big.withColumn("_row", F.monotonically_increasing_id()))
    left = left.withColumn("_salt", F.pmod("_row", salts).cast("int")).drop("_salts", "_row")
    right = with_salts(other).withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("_salts")
    return plain(left).join(plain(right), [*keys, "_salt"], how).drop("_salt")


def spread(df: DataFrame) -> DataFrame:
    """Deal rows out when the input comes in fewer pieces than there are cores; for costly per-row work only."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def keep_value(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column and drop the rows where it is NULL, evaluating it once.

    A plain filter would be pushed below and repeat the whole expression, costly ones several times over.
    """
    return df.withColumn(name, F.explode(F.array_compact(F.array(value))))


def _flip(orders: list[Column | str]) -> list[Column]:
    return [F.col(o) if isinstance(o, str) else o for o in orders]


def rank_within(
    df: DataFrame, keys: list[str], order: list[Column | str], name: str = "pos", hot_rows: int | None = None
) -> DataFrame:
    """1-based position of every row inside its key.

    A plain window while no key has more than `hot_rows` rows, by a count with map-side sums. Otherwise (and always for
    a whole-table position) rows are range-partitioned by key and order, numbered per range, and shifted by the
    counts of the earlier ranges of the same key; no key is gathered in one task. `order` must be total.
    """
    order = _flip(order)
    if keys:
        if hot_keys(df, keys, hot_rows or HOT_ROWS) is None:
            return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    parts = df.sparkSession.sparkContext.defaultParallelism
    shuffle = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # stored once: the range bounds come from a sample and must not be drawn a second time
    ranged = cut_lineage(
        df.repartitionByRange(max(parts, shuffle), *keys, *order).withColumn("_range", F.spark_partition_id()))
    local = Window.partitionBy("_range", *keys).orderBy(*order)
    counts = ranged.groupBy("_range", *keys).agg(F.count(F.lit(1)).alias("_n"))
    # Only keys that cross a range border get a shift, so this table has fewer rows than there are ranges.
    shift = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    shifts = counts.withColumn("_shift", shift).where(F.col("_shift") > 0).drop("_n")
    cond = [ranged["_range"] == shifts["_range"]] + [ranged[k].eqNullSafe(shifts[k]) for k in keys]
    numbered = ranged.withColumn("_local", F.row_number().over(local))
    out = numbered.join(F.broadcast(shifts), cond, "left")
    return out.select(
        *[numbered[c] for c in df.columns],
        (F.col("_local") + F.coalesce(F.col("_shift"), F.lit(0))).cast("int" if keys else "long").alias(name),
    )


def top_k(df: DataFrame, keys: list[str], order: list[Column | str], k: int, name: str = "rn") -> DataFrame:
    """First k rows per key. Spark cuts each task's share to k per key before the shuffle (group limit)."""
    w = Window.partitionBy(*keys).orderBy(*_flip(order))
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= k)


def first_per_key(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    return top_k(df, keys, order, 1, "_rn").drop("_rn")
