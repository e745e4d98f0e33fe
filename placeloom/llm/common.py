"""Small helpers of the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from placeloom.session import cut_lineage, drop_step, durable_root, scratch_path  # noqa: F401  (one import place for the operators)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """The text with NULL read as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def private(df: DataFrame, name: str) -> str:
    """A column name that the input does not use (columns compare without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def text_batches(df: DataFrame, rows: int = 500) -> DataFrame:
    """df, whose session hands at most `rows` rows at a time to Python, so that a worker holds few texts at once.

    The default of 10 000 rows is made for numbers. A smaller setting of the user stays.
    """
    conf, name = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(name)) <= rows:
        conf.set(name, str(rows))
    return df
