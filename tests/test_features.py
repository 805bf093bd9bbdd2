from pyspark.sql import functions as F

from duskline.operators import features as ft
from duskline.sources.scratch import settle
from tests.conftest import month, rows


def _panel(spark, months, id=1, value=None):
    return spark.createDataFrame(
        [(id, month(m), float(value or (i + 1))) for i, m in enumerate(months)],
        "id long, period date, v double",
    )


def _anchor(spark, event, id=1):
    return spark.createDataFrame([(id, month(event))], "id long, event date")


def test_gap_month_is_zero_and_shifts_nothing(spark):
    p = _panel(spark, ["2018-01", "2018-02", "2018-04", "2018-05"])
    row = ft.lag_features(_anchor(spark, "2018-08"), p, ["v"], n=5).head()
    assert [row[f"v_M_{i}"] for i in range(1, 6)] == [4.0, 3.0, 0.0, 2.0, 1.0]


def test_anchor_without_rows_is_all_zero(spark):
    p = _panel(spark, ["2010-01"])
    row = ft.lag_features(_anchor(spark, "2018-08"), p, ["v"]).head()
    assert {row[c] for c in ft.lag_names(["v"])} == {0.0}


def test_nothing_after_the_anchor_is_read(spark):
    months = [f"2017-{m:02d}" for m in range(1, 13)] + [f"2018-{m:02d}" for m in range(1, 9)]
    p = _panel(spark, months)
    late = p.withColumn("v", F.when(F.col("period") > month("2018-05"), 9e9).otherwise(F.col("v")))
    a = _anchor(spark, "2018-08")
    assert rows(ft.lag_features(a, p, ["v"])) == rows(ft.lag_features(a, late, ["v"]))


def test_annual_block_is_the_known_year(spark):
    annual = spark.createDataFrame(
        [(1, 2016, 16.0), (1, 2017, 17.0), (1, 2018, 18.0)], "id long, year int, s double"
    )
    anchors = spark.createDataFrame(
        [(1, month("2018-06")), (1, month("2018-07")), (1, month("2015-01"))],
        "id long, event date",
    )
    got = {r.event: r.s_Y_1 for r in ft.annual_features(anchors, annual, ["s"]).collect()}
    assert got == {month("2018-06"): 16.0, month("2018-07"): 17.0, month("2015-01"): 0.0}


def test_dense_equals_sparse(spark):
    p = _panel(spark, ["2017-01", "2017-03", "2017-04", "2018-02"]).unionByName(
        _panel(spark, ["2017-06", "2018-06"], id=2)
    )
    dense = ft.lag_features_dense(p, ["v"])
    sparse = ft.lag_features(dense.select("id", "event"), p, ["v"])
    assert rows(dense) == rows(sparse)
    assert dense.count() == 2 * 18


def test_filled_count_matches_wide_row(spark):
    p = _panel(spark, ["2018-01", "2018-03", "2018-05"])
    a = _anchor(spark, "2018-08").unionByName(_anchor(spark, "2018-08", id=7))
    wide = ft.lag_features(a, p, ["v"])
    nonzero = sum((F.col(c) != 0).cast("int") for c in ft.lag_names(["v"]))
    assert rows(ft.filled_lag_cells(a, p, ["v"]), "id", "filled") == rows(
        wide.select("id", nonzero.alias("filled"))
    )


def test_dense_annual_equals_sparse(spark):
    p = _panel(spark, ["2016-01", "2017-03", "2018-11"]).unionByName(_panel(spark, ["2017-06"], id=2))
    annual = spark.createDataFrame(
        [(1, y, float(y), None) for y in (2015, 2016, 2017)], "id long, year int, s double, t double"
    )
    dense = ft.lag_features_dense(p, ["v"])
    a = ft.annual_features_dense(dense, annual, ["s", "t"])
    b = ft.annual_features(dense, annual, ["s", "t"])
    assert rows(a) == rows(b)


def test_dense_rows_move_once(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        p = _panel(spark, ["2016-01", "2017-03", "2018-11"])
        annual = spark.createDataFrame([(1, 2016, 1.0)], "id long, year int, s double")
        wide = ft.annual_features_dense(ft.lag_features_dense(p, ["v"]), annual, ["s"])
        plan = wide._jdf.queryExecution().executedPlan().toString()
        above_window = plan[: plan.index("Window [")]
        assert "Exchange" not in above_window
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_dense_rows_of_asked_months(spark):
    p = _panel(spark, ["1900-01", "2016-01", "2016-11", "2017-03", "2018-11"]).unionByName(
        _panel(spark, ["2017-06", "2018-06"], id=2)
    )
    off = spark.createDataFrame([(2, 6), (2, 6), (2, 7), (3, 1)], "id long, month int")
    got = ft.lag_features_dense(p, ["v"], years=[2016, 2018], without=off)
    active = p.select("id", F.year("period").alias("y")).distinct()
    want = (
        ft.lag_features_dense(p, ["v"]).withColumn("y", F.year("event")).filter(F.col("y").isin(2016, 2018))
        .join(active, ["id", "y"], "left_semi").drop("y").withColumn("month", F.month("event"))
        .join(off, ["id", "month"], "left_anti").drop("month")
    )
    assert rows(got, *want.columns) == rows(want)
    assert got.count() == 12 + 11 + 9  # the calendar ends in 2018-11


def test_dense_rows_outside_the_panel(spark):
    assert ft.lag_features_dense(_panel(spark, ["2016-01"]), ["v"], years=[2020]).isEmpty()
    assert ft.lag_features_dense(_panel(spark, ["2016-01"]).limit(0), ["v"]).isEmpty()


def test_many_anchors_are_dealt_by_entity(spark, monkeypatch):
    panel = spark.createDataFrame(
        [(i, month(f"2018-{m:02d}"), 2018, float(i * m % 3), None if m % 4 else 1.0) for i in (1, 2, 3, 4) for m in range(1, 13)]
        + [(2, month("2018-03"), 2018, 5.0, 5.0), (None, month("2018-03"), 2018, 1.0, 1.0)],
        "id long, period date, year int, a double, b double",
    )
    anchors = [(r, i, month(f"2019-{m:02d}")) for r in (1, None) for i in (1, 2, 3, 9, None) for m in (1, 5, 9)]
    anchors = spark.createDataFrame(anchors + anchors[:4], "ratio int, id long, event date")
    single = panel.filter("id <> 2")

    def found():
        return [rows(ft.filled_lag_cells(anchors, panel, ["a", "b"]).select(F.to_json(F.struct("*")).alias("x"))),
                rows(ft.lag_features(anchors, single, ["a", "b"]).select(F.to_json(F.struct("*")).alias("x")))]

    few = found()
    monkeypatch.setattr(ft, "ANCHORS_A_TASK", 3)
    assert found() == few
    # Nothing is moved after the join, and the partitions grow with the anchors.
    plan = ft.filled_lag_cells(anchors, panel, ["a", "b"])._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(id" in plan and ", 12)" in plan
    assert "Exchange" not in plan[: plan.index("Join")]


def test_many_anchors_do_not_broadcast_the_annual_rows(spark, monkeypatch):
    annual = settle(spark.range(2000).selectExpr("id", "2017 AS year", "CAST(id AS DOUBLE) AS s"))
    anchors = settle(spark.range(3000).withColumn("event", F.lit(month("2018-08"))))
    few = ft.annual_features(anchors, annual, ["s"])
    monkeypatch.setattr(ft, "ANCHORS_A_TASK", 1000)
    many = ft.annual_features(anchors, annual, ["s"])
    assert "BroadcastHashJoin" in few._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in many._jdf.queryExecution().executedPlan().toString()
    assert many.exceptAll(few).isEmpty() and many.count() == 3000
