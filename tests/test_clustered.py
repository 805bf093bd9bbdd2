"""The panel stored by entity is not shuffled again; results do not depend on how it is stored."""

import pytest
from pyspark.sql import functions as F

from duskline.operators import features as ft
from duskline.plans import clustered_queries as cq, load
from duskline.sources.clustered import _ALL_KEYS, by_entity, cluster_panel
from duskline.sources.scratch import settle
from tests.conftest import month
from tests.oracle import compare, connect


@pytest.fixture(params=["broadcast", "no broadcast"])
def joins(spark, request):
    if request.param == "no broadcast":
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    yield request.param
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_no_exchange_of_the_panel(spark, tiny, joins):
    panel = cq.stored_panel(spark, tiny)
    plan = lambda: cq.lags_by_entity(panel)._jdf.queryExecution().executedPlan().toString()
    with by_entity(spark):
        found = plan()
    assert "Bucketed: true" in found and "Exchange hashpartitioning" not in found
    if joins == "no broadcast":
        assert "Exchange hashpartitioning" in plan()


def test_setting_comes_back_after_an_error(spark):
    before = spark.conf.get(_ALL_KEYS)
    with pytest.raises(ZeroDivisionError), by_entity(spark):
        1 / 0
    assert spark.conf.get(_ALL_KEYS) == before


def test_equals_the_unstored_panel_and_sql(spark, tiny):
    found, sql = load()
    got = found["clustered_lags"](spark, tiny)
    assert compare(got, connect(tiny), sql["clustered_lags"]) is None
    plain = settle(cq.stored_panel(spark, tiny), "plain")
    assert cq.lags_by_entity(plain).exceptAll(got).isEmpty() and got.count() == cq.lags_by_entity(plain).count()


def test_null_keys_and_empty_panels(spark):
    schema = "id long, period date, n double"
    rows = [(None, month("2018-01"), 1.0), (1, month("2018-01"), 2.0), (1, month("2018-02"), 3.0)]
    stored = cluster_panel(spark.createDataFrame(rows, schema), buckets=3)
    assert sorted(r["n"] for r in stored.collect()) == [1.0, 2.0, 3.0]
    with by_entity(spark):
        lags = ft.lag_features_dense(stored.filter("id IS NOT NULL"), ["n"], n=2, gap=0).orderBy("event").collect()
    assert [(r["n_M_1"], r["n_M_2"]) for r in lags] == [(2.0, 0.0), (3.0, 2.0)]
    empty = cluster_panel(spark.createDataFrame([], schema), buckets=3)
    assert empty.count() == 0 and empty.columns == ["id", "period", "n"]


def test_buckets_grow_with_the_customers(spark, tiny, monkeypatch):
    monkeypatch.setattr(cq, "A_BUCKET", 10)
    assert cq.fx.customers(spark, tiny).count() > 120
    # A file per bucket; the session's shuffle has eight partitions.
    assert len(cq.stored_panel(spark, tiny).inputFiles()) > 8
