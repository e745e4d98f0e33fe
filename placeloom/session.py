"""Session settings and durable intermediate storage."""

from __future__ import annotations

import re
import tempfile
import uuid

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "placeloom", master: str | None = None, **conf: str) -> SparkSession:
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
        **conf,
    }
    for key, value in settings.items():
        b = b.config(key, value)
    return b.getOrCreate()


def durable_root(spark: SparkSession) -> str:
    """The shared folder named by spark.checkpoint.dir; a private temporary one on a local master only."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark.sparkContext.setCheckpointDir(root)
    return spark.sparkContext.getCheckpointDir()


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{durable_root(spark).rstrip('/')}/placeloom-{label}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write the rows as a table in durable storage and go on from there.

    Survives lost executors, and the table's real size is known to the planner, which a kept lineage or a plain
    checkpoint would only estimate.
    """
    path = scratch_path(df.sparkSession, "step")
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._step_path = path
    return out


def drop_step(df: DataFrame | None) -> None:
    """Delete the table behind a frame made by cut_lineage, once nothing reads it any more; other frames stay as they are.

    For loops, which store a new step each round. A store that pyarrow has no file system for keeps its steps until the
    folder is cleared.
    """
    path = getattr(df, "_step_path", None)
    if path is None:
        return
    try:
        fs, root = pafs.FileSystem.from_uri(re.sub("^file:/+", "file:///", path))
    except (pa.ArrowInvalid, OSError):
        return
    fs.delete_dir(root)
