import datetime as dt

import pytest
from pyspark.sql import Window, functions as F

from duskline.functions.seeds import digest
from duskline.operators import datasets as ds, sampling as sp
from tests.conftest import month, rows


def _brute(df, by, n, seed, key):
    w = Window.partitionBy(*by).orderBy(digest(seed, *key), *key)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= n).drop("_rn")


@pytest.mark.parametrize("bits", [1, 4, 12])
@pytest.mark.parametrize("n", [0, 1, 700, 5000])
def test_take_seeded_equals_sorting(spark, bits, n):
    """One group holds two thirds of the rows, one has no name."""
    df = spark.range(3000).select(
        "id", F.when(F.col("id") < 2000, "hot").when(F.col("id") < 2500, "cold").alias("g")
    )
    got = sp.take_seeded(df, ["id"], n, 7, ["g"], cell_bits=bits)
    assert rows(got, "id") == rows(_brute(df, ["g"], n, 7, ["id"]), "id")


def test_draws_ignore_partitioning(spark):
    df = spark.range(1000)
    a = sp.sample_n(df.repartition(1), 100, 5)
    b = sp.sample_n(df.repartition(7), 100, 5)
    assert rows(a) == rows(b) and a.count() == 100


def test_folds_partition_the_rows(spark):
    df = sp.assign_folds(spark.range(500), 5, 101, ["id"])
    seen = []
    for i in range(5):
        train, validate = sp.fold_split(df, i)
        assert train.count() + validate.count() == 500
        seen += [r.id for r in validate.collect()]
    assert sorted(seen) == list(range(500))


def test_downsample_per_group(spark):
    df = spark.range(400).select("id", (F.col("id") % 20 == 0).cast("int").alias("y"),
                                 (F.col("id") % 2).alias("g"))
    got = sp.downsample(df, "y", 3, 1, ["id"], ["g"]).groupBy("g", "y").count()
    assert rows(got) == [(0, 0, 60), (0, 1, 20)]
    assert sp.downsample(df, "y", 3, 1, ["id"]).count() == 80


def _events(spark, n_hot, n_cold):
    data = [(i, month("2018-03")) for i in range(n_hot)]
    data += [(1000 + i, month("2018-09")) for i in range(n_cold)]
    return spark.createDataFrame(data, "id long, event date")


def test_matching_keeps_quota_and_uses_each_id_once(spark):
    events = _events(spark, 40, 5)
    pool = spark.range(5000, 6000).toDF("id")
    quotas = sp.control_quotas(events, 2)
    got = sp.match_controls(pool, quotas, 101)
    assert rows(got.groupBy("event").count()) == [(month("2018-03"), 80), (month("2018-09"), 10)]
    assert got.select("id").distinct().count() == 90
    short = sp.match_controls(pool.limit(30), quotas, 101)
    audit = sp.control_shortfall(short, quotas)
    assert all(r.kept <= r.quota and r.missing == r.quota - r.kept for r in audit.collect())
    assert short.count() == audit.agg(F.sum("kept")).head()[0]


def test_matching_respects_emptiness(spark):
    events = _events(spark, 10, 10)
    pool = spark.range(200).toDF("id")
    got = sp.match_controls(
        pool, sp.control_quotas(events, 1), 3,
        filled=lambda a: a.withColumn("filled", (F.col("id") % 2).cast("int")),
    )
    assert got.count() == 20 and got.filter(F.col("id") % 2 == 0).count() == 0


def test_matching_per_ratio_is_independent(spark):
    many = F.explode(F.array(F.lit(1), F.lit(3)))
    events = _events(spark, 8, 2).withColumn("ratio", many)
    pool = spark.range(2000, 4000).toDF("id").withColumn("ratio", many)
    quotas = sp.control_quotas(events, F.col("ratio"), ["ratio"])
    got = sp.match_controls(pool, quotas, 9, by=["ratio"])
    assert rows(got.groupBy("ratio", "event").count()) == [
        (1, month("2018-03"), 8), (1, month("2018-09"), 2),
        (3, month("2018-03"), 24), (3, month("2018-09"), 6),
    ]


def test_monthly_sets_drop_that_months_event_entities(spark):
    e = spark.createDataFrame([(1, month("2017-03"), 1)], "id long, event date, status int")
    h = spark.createDataFrame(
        [(1, month("2018-03"), 0), (1, month("2018-04"), 0), (2, month("2018-03"), 0)],
        "id long, event date, status int",
    )
    got = rows(ds.monthly_sets(h, e, 2018), "month", "id", "status", "split")
    assert got == [(3, 1, 1, "train"), (3, 2, 0, "test"), (4, 1, 0, "test")]


@pytest.mark.parametrize("n", [0, 1, 2, 7, 501])
def test_first_fraction_is_exact(spark, n):
    df = spark.range(n).selectExpr("IF(id = 3, NULL, id) AS id", "id % 5 AS x")
    got = sp.first_fraction(df, 0.5, 101, ["id"])
    ids = [r["id"] for r in got.collect()]
    assert len(ids) == len(set(ids)) == n // 2
    assert got.columns == df.columns
    again = [r["id"] for r in sp.first_fraction(df.repartition(3), 0.5, 101, ["id"]).collect()]
    assert set(ids) == set(again)


def test_yearly_combine_halves_one_year_exactly(spark):
    e = spark.createDataFrame([(10**6, month("2015-03"), 1)], "id long, event date, status int")
    h = spark.createDataFrame([(i, dt.date(2014, 1, 1), 0) for i in range(1, 40)], "id long, event date, status int")
    got = ds.yearly_combine(h, e, [2014, 2015], 2014, 101)
    assert got.filter("status = 0").count() == 19


def test_yearly_combine_one_row_per_id_and_class(spark):
    e = spark.createDataFrame([(1, month("2015-03"), 1)], "id long, event date, status int")
    h = spark.createDataFrame(
        [(i, dt.date(y, 1, 1), 0) for i in range(1, 40) for y in (2014, 2015, 2016)],
        "id long, event date, status int",
    )
    got = ds.yearly_combine(h, e, [2014, 2015, 2016], 2014, 101)
    assert got.groupBy("id", "status").count().filter("count > 1").isEmpty()
    assert got.filter("id = 1").count() == 1


def test_combine_drops_one_sided_columns(spark):
    a = spark.createDataFrame([(1, 2, 3)], "id int, x int, only_a int")
    b = spark.createDataFrame([(2, 5)], "id int, x int")
    assert ds.combine_classes(a, b).columns == ["id", "x"]
    assert ds.stack(a, b).columns == ["id", "x", "only_a"]
