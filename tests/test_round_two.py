"""Exact curves, stratified folds, filled quotas, null keys, calendars and correlations."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from duskline.evaluation import curves as cv
from duskline.models import forest as fr
from duskline.operators import features as ft, profiles as pr, projection as pj, sampling as sp
from duskline.plans import company
from tests.conftest import month, rows


def test_curves_of_tiny_scores_are_exact(spark):
    rng = random.Random(1)
    data = [("m", int(rng.random() < 0.2), rng.random() * 0.005) for _ in range(600)]
    data += [("m", y, 0.001) for y in (0, 1, 1)]
    df = spark.createDataFrame(data, "model string, target int, score double")
    pos, neg = [s for _, y, s in data if y], [s for _, y, s in data if not y]
    exact = sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg))
    assert cv.auc(df).head().auc == pytest.approx(exact, abs=1e-6)
    points = cv.roc_curve(df).collect()
    assert len(points) == len({s for _, _, s in data})
    for r in points[::50]:
        assert r["tpr"] == pytest.approx(sum(s >= r["score"] for s in pos) / len(pos), abs=1e-6)


def test_curve_plan_has_no_window_over_a_whole_model(spark, tiny):
    df = spark.range(1000).selectExpr("'m' AS model", "CAST(id % 2 AS INT) AS target", "rand(3) AS score")
    plan = cv.auc(df)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "_range" in plan


@pytest.mark.parametrize("bits", [1, 12])
def test_folds_are_stratified(spark, bits):
    df = spark.range(1003).selectExpr("id", "CASE WHEN id < 23 THEN 1 WHEN id < 1000 THEN 0 END AS y")
    got = sp.assign_folds(df, 5, 3, ["id"], label="y", cell_bits=bits)
    per = got.groupBy("y", "fold").count().groupBy("y").agg(F.max("count") - F.min("count"), F.count("*"))
    assert {tuple(r) for r in per.collect()} == {(1, 1, 5), (0, 1, 5), (None, 0, 3)}


def test_training_without_two_classes_is_refused(spark):
    df = spark.range(40).selectExpr("id", "0 AS status", "CAST(id AS DOUBLE) AS x")
    data = fr.prepare(df, ["x"], ["id", "status"])
    with pytest.raises(ValueError, match="two classes"):
        fr.cross_scores(data, 1, 2)


def test_full_cells_are_not_sorted(spark):
    drawn = sp.take_seeded(spark.range(1000), ["id"], 900, 3)
    assert drawn.count() == 900
    logical = drawn._jdf.queryExecution().optimizedPlan().toString()
    window = logical[logical.index("Window") :]
    assert logical.count("Window") == 1 and "(_cell" in window.replace("Filter ", "") or "_edge" in window


def test_open_quotas_are_filled_from_unused_entities(spark):
    """Ten months want three each; an entity fits two neighbouring months only."""
    months = [dt.date(2018, m, 1) for m in range(1, 11)]
    quotas = spark.createDataFrame([(m, 3) for m in months], "event date, quota long")
    fits = [(i, months[(i + d) % 10]) for i in range(40) for d in (0, 1)]
    able = spark.createDataFrame(fits, "id long, event date").withColumn("filled", F.lit(1))
    check = lambda a: a.join(able, ["id", "event"], "left").fillna(0, ["filled"]).select(*a.columns, "filled")
    pool = spark.range(40)
    dealt = sp.match_controls(pool, quotas, 5, filled=check)
    full = sp.match_controls(pool, quotas, 5, filled=check, fill=True)
    assert dealt.count() < 30 == full.count() == full.select("id").distinct().count()
    assert full.join(able, ["id", "event"], "left_anti").isEmpty()
    assert rows(sp.control_shortfall(full, quotas), "missing") == [(0,)] * 10
    wanted = quotas.withColumn("quota", F.lit(50).cast("long"))
    most = sp.match_controls(pool, wanted, 5, filled=check, fill=True)
    assert most.count() == 40  # nobody is left over


def test_null_keys_keep_their_rows(spark):
    panel = spark.createDataFrame([(1, month("2018-01"), 5.0)], "id long, period date, n double")
    annual = spark.createDataFrame([(1, 2017, 2.0)], "id long, year int, a double")
    anchors = spark.createDataFrame([(1, month("2018-06"), None), (1, month("2018-06"), "x")], "id long, event date, tag string")
    assert ft.feature_rows(anchors, panel, ["n"], annual, ["a"]).count() == 2
    df = spark.range(300).selectExpr("id", "CAST(id % 30 = 0 AS INT) AS y", "IF(id < 150, 'g', NULL) AS g")
    got = sp.downsample(df, "y", 2, 1, ["id"], ["g"]).groupBy("g", "y").count()
    assert {tuple(r) for r in got.collect()} == {("g", 0, 10), ("g", 1, 5), (None, 0, 10), (None, 1, 5)}


def test_calendar_has_every_month_and_counts_other_years(spark):
    df = spark.createDataFrame([(1, month("2018-03")), (1, month("1990-03"))], "status int, event date")
    got = pr.class_calendar(df, [2018]).collect()
    assert len(got) == 24 and sum(r["y2018"] for r in got) == sum(r["other_years"] for r in got) == 1


def test_correlation_methods_width_and_nulls(spark):
    df = spark.range(50).selectExpr("CAST(id AS DOUBLE) AS a", "exp(id / 5) AS b", "1 AS c", "IF(id = 0, NULL, id) AS d")
    r = {(x["a"], x["b"]): x["r"] for x in pr.corr_matrix(df, ["a", "b", "c", "d"], 4, "spearman").collect()}
    assert r["a", "b"] == 1.0 and r["a", "c"] is None and r["a", "d"] is None
    p = {(x["a"], x["b"]): x["r"] for x in pr.corr_matrix(df, ["a", "b"], 4).collect()}
    assert p["a", "b"] == pytest.approx(df.stat.corr("a", "b"), abs=1e-4) and p["a", "b"] == p["b", "a"] < 1
    wide = spark.range(200).select(*[F.rand(i).alias(f"x{i}") for i in range(50)])
    assert pr.corr_matrix(wide, wide.columns).count() == 2500


def test_complete_cases_reach_the_scan(spark, tiny):
    plan = pj.complete_cases(spark.read.parquet(f"{tiny}/orders.parquet"), ["o_custkey"])._jdf.queryExecution()
    assert "PushedFilters: [IsNotNull(o_custkey)]" in plan.executedPlan().toString()


def test_company_months_are_single_and_dated(spark):
    schema = f"id long, DATE string, {company.STATUS} double, v double"
    raw = spark.createDataFrame(
        [(1, "01JAN2018", None, 1.0), (1, "01JAN2018", float(company.EVENT_STATUS), 2.0), (1, "no date", None, 3.0),
         (2, "01FEB2018", None, 5.0), (2, "01FEB2018", None, 5.0)], schema,
    )
    got = company.with_period(raw)
    assert rows(got, "id", "v") == [(1, 2.0), (2, 5.0)]
    assert company.undated_rows(raw).head()["rows"] == 1
