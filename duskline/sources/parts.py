"""Parts of a table that are there once, however often a run is repeated or breaks off."""

from __future__ import annotations

from urllib.parse import quote

from pyspark.sql import DataFrame, SparkSession, functions as F

from duskline.sources.scratch import scratch_path

ENTRY = "name string, run string, rows long, digest string"


def _folders(spark: SparkSession, root: str) -> list[str]:
    """Committed entries; a writer that ended leaves its mark."""
    pattern = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/manifest/part=*/_SUCCESS")
    found = pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern)
    return sorted(f.getPath().getParent().toString() for f in found or [])


def committed(spark: SparkSession, root: str) -> DataFrame:
    """One row per part that is there: name, run, rows, digest."""
    folders = _folders(spark, root)
    return spark.read.schema(ENTRY).parquet(*folders) if folders else spark.createDataFrame([], ENTRY)


def _content(df: DataFrame) -> DataFrame:
    """Row count and a digest of all rows, whatever their order."""
    cells = F.xxhash64(*[F.col(f"`{c}`") for c in sorted(df.columns)]).cast("decimal(38,0)")
    return df.agg(F.count("*").alias("rows"), F.coalesce(F.sum(cells), F.lit(0)).cast("string").alias("digest"))


def write_part(df: DataFrame, root: str, name: str, run: str) -> bool:
    """Write ``df`` as part ``name``, in place of what an earlier run wrote under it; False if it was there.

    The rows go to a folder of their own run. One manifest entry, written last, makes them the part;
    what a crashed run left has no entry and is never read. A part whose entry has this run and
    the same rows is not written again; a run's name must not be used by two writers at a time.

    ``df`` is computed once, into the scratch folder: a limit, or whatever else may give other rows
    when it is computed again, has one digest.
    """
    spark = df.sparkSession
    once = scratch_path(spark, "part")
    df.write.parquet(once)
    try:
        return _commit(spark.read.schema(df.schema).parquet(once), root, name, run)
    finally:
        files = spark._jvm.org.apache.hadoop.fs.Path(once)
        files.getFileSystem(spark._jsc.hadoopConfiguration()).delete(files, True)


def _commit(df: DataFrame, root: str, name: str, run: str) -> bool:
    spark = df.sparkSession
    entry = f"{root}/manifest/part={quote(name, safe='')}"
    now = _content(df).select(F.lit(name).alias("name"), F.lit(run).alias("run"), "rows", "digest")
    fresh = now.first()
    if fresh in committed(spark, root).filter(F.col("name") == name).collect():
        return False
    data = f"{root}/data/part={quote(name, safe='')}/run={quote(run, safe='')}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(entry)
    old = spark._jvm.org.apache.hadoop.fs.Path(data)
    if old.getFileSystem(spark._jsc.hadoopConfiguration()).exists(old):
        # Written under this run before: without its entry first, as it is about to change.
        hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
    df.write.mode("overwrite").parquet(data)
    written = _content(spark.read.schema(df.schema).parquet(data)).first()
    if (written["rows"], written["digest"]) != (fresh["rows"], fresh["digest"]):
        raise RuntimeError(f"part {name}: {written['rows']} rows were written, {fresh['rows']} were expected")
    spark.createDataFrame([tuple(fresh)], ENTRY).coalesce(1).write.mode("overwrite").parquet(entry)
    return True


def read_committed(spark: SparkSession, root: str) -> DataFrame:
    """All committed parts as one table with ``part``; a ValueError if there is none."""
    entries = committed(spark, root).orderBy("name").collect()
    if not entries:
        raise ValueError(f"no part is committed in {root}")
    out = None
    for r in entries:
        path = f"{root}/data/part={quote(r['name'], safe='')}/run={quote(r['run'], safe='')}"
        rows = spark.read.parquet(path).withColumn("part", F.lit(r["name"]))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out
