"""One key holds a third of the rows or more."""

from pyspark.sql import functions as F

from duskline.operators import features as ft, joins, sampling as sp, timeline as tl
from duskline.sources.scratch import scratch_path, settle
from tests.conftest import month, rows


def _largest_share(df):
    sizes = [r["count"] for r in df.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    return max(sizes) / sum(sizes)


def test_salted_join_is_right_and_even(spark):
    big = spark.range(40_000).select("id", F.when(F.col("id") % 2 == 0, 1).otherwise(F.col("id")).alias("k"))
    small = spark.createDataFrame([(1, "hot"), (3, "three")], "k long, v string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.enabled", False)
    try:
        salted = joins.salted_join(big, small, ["k"], ["id"], salts=64)
        plain = big.join(small, "k", "left")
        assert _largest_share(salted) < 0.3 < 0.5 < _largest_share(plain)
        assert salted.select("id", "v").exceptAll(plain.select("id", "v")).isEmpty()
        # every even id and id 1 itself
        assert salted.count() == 40_000 and salted.filter(F.col("v") == "hot").count() == 20_001
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_quota_draw_spreads_one_group(spark):
    df = spark.range(40_000).select("id", F.lit("all").alias("g"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.enabled", False)
    try:
        got = sp.take_seeded(df, ["id"], 30_000, 1, ["g"])
        assert got.count() == 30_000 and _largest_share(got) < 0.3
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_hot_entity_is_cut_before_the_shuffle(spark):
    raw = spark.range(9_000).select(
        F.when(F.col("id") < 6_000, 1).otherwise(F.col("id")).alias("id"),
        F.lit(month("2018-01")).alias("period"),
        F.col("id").alias("o"),
    )
    first = tl.dedupe(raw, ["id", "period"], [F.col("o")])
    plan = first._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    assert first.count() == 3_001


def test_few_anchors_do_not_shuffle_the_panel(spark):
    panel = spark.range(200_000).select(
        (F.col("id") % 5000).alias("id"),
        F.add_months(F.lit(month("2015-01")), (F.col("id") / 5000).cast("int")).alias("period"),
        F.col("id").cast("double").alias("v"),
    )
    anchors = spark.createDataFrame([(1, month("2018-01")), (2, month("2017-01"))], "id long, event date")
    small = F.broadcast(anchors)
    wide = ft.lag_features(small, panel, ["v"])
    plan = wide._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert wide.count() == 2


def test_window_reads_only_the_reachable_years(spark):
    path = scratch_path(spark, "yearly")
    spark.range(120).select(
        F.lit(1).cast("long").alias("id"),
        F.add_months(F.lit(month("2010-01")), F.col("id").cast("int")).alias("period"),
        F.col("id").cast("double").alias("v"),
    ).withColumn("year", F.year("period")).write.partitionBy("year").parquet(path)
    panel = spark.read.parquet(path)
    anchors = settle(spark.createDataFrame([(1, month("2016-04"))], "id long, event date"))
    wide = ft.lag_features(anchors, panel, ["v"])
    row = wide.head()
    assert [row[f"v_M_{i}"] for i in (1, 12)] == [72.0, 61.0]
    plan = wide._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in plan
