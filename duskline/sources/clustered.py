"""A panel stored by entity, so that what follows works on each entity where it lies."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from duskline.sources.scratch import scratch_path

_ALL_KEYS = "spark.sql.requireAllClusterKeysForCoPartition"


def cluster_panel(
    df: DataFrame, name: str = "panel", buckets: int | None = None, key: str = "id", order: str = "period"
) -> DataFrame:
    """``df`` written in buckets of ``key``, sorted within them, and read back as a table.

    The one shuffle of the panel. A later grouping, window or join on ``key`` and further columns
    needs none (see ``by_entity``). An entity has at most one row per month and copies of it, so
    no bucket is much larger than another; ``buckets`` is the number of shuffle partitions unless
    given, and should leave some hundred megabytes in each. Null keys are one bucket; an empty
    panel is an empty table. The files lie in the shared scratch folder and the table is known to
    this session only.
    """
    spark = df.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"{name}_{uuid.uuid4().hex}"
    path = scratch_path(spark, name)
    (
        df.repartition(n, key)
        .write.format("parquet")
        .bucketBy(n, key)
        .sortBy(key, order)
        .option("path", path)
        .saveAsTable(table)
    )
    files = spark._jvm.org.apache.hadoop.fs.Path(path)
    files.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(files)
    return spark.table(table)


@contextmanager
def by_entity(spark: SparkSession) -> Iterator[None]:
    """Joins on the entity and further columns may use a partitioning by the entity alone.

    Spark asks for all join columns by default, as one of them alone may be uneven; an entity of
    a panel is not. Plans are made when a result is written, so write it inside the block.
    """
    before = spark.conf.get(_ALL_KEYS)
    spark.conf.set(_ALL_KEYS, "false")
    try:
        yield
    finally:
        spark.conf.set(_ALL_KEYS, before)
