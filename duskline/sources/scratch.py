"""Shared scratch space and the ways to cut a long lineage.

Everything intermediate goes under ``spark.checkpoint.dir``, which a cluster points
at storage all executors see. Only a local session without that setting gets a
temporary folder of this machine.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SETTING = "spark.checkpoint.dir"
_local_root: str | None = None


def scratch_root(spark: SparkSession) -> str:
    global _local_root
    root = spark.conf.get(_SETTING, None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {_SETTING} to a folder all executors can reach")
    if _local_root is None:
        _local_root = tempfile.mkdtemp(prefix="duskline-")
    return _local_root


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared scratch folder."""
    return f"{scratch_root(spark)}/duskline/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame, name: str = "settled") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Later uses survive lost executors without recomputation, and the planner sees the
    true size of the files instead of an estimate, so a small result is broadcast by
    Spark's own size threshold and a large one is not. Files of few values are much smaller than their
    rows in memory: see ``joins.grown``. The files go when the driver ends.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    files = spark._jvm.org.apache.hadoop.fs.Path(path)
    files.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(files)
    return spark.read.schema(df.schema).parquet(path)
