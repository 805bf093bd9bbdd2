import datetime as dt

import pytest
from pyspark.sql import functions as F, types as T

from duskline.functions import dates as d
from duskline.functions.numbers import number_from_text, strict_sum
from duskline.operators import exclusion as ex, profiles as pr, projection as pj, timeline as tl
from duskline.sources import panel_io as io
from duskline.sources.scratch import scratch_path
from tests.conftest import month, rows


def test_dates(spark):
    df = spark.createDataFrame([("01JAN2018",), ("01MAR2018",), ("nonsense",)], "t string")
    got = df.select(
        d.parse_period("t").alias("p"),
        d.format_period(d.previous_month(d.parse_period("t"))).alias("b"),
    ).collect()
    assert [r.p for r in got] == [month("2018-01"), month("2018-03"), None]
    assert [r.b for r in got] == ["01DEC2017", "01FEB2018", None]


def test_anchor_and_known_year(spark):
    events = [month(f"2018-{m:02d}") for m in (1, 3, 6, 7)]
    df = spark.createDataFrame([(e,) for e in events], "event date")
    got = df.select(d.anchor_month("event").alias("a"), d.known_year("event").alias("y")).collect()
    assert [r.a for r in got] == [month(x) for x in ("2017-10", "2017-12", "2018-03", "2018-04")]
    assert [r.y for r in got] == [2016, 2016, 2016, 2017]


def test_number_text(spark):
    df = spark.createDataFrame([("1,234.50",), ("abc",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(number_from_text("t")).collect()] == [1234.5, None, None, None]


def test_csv_blank_rules(spark):
    schema = T.StructType(
        [T.StructField(n, t) for n, t in
         [("KEY", T.LongType()), ("seg", T.StringType()), ("v", T.DoubleType())]]
    )
    path = scratch_path(spark, "csv")
    spark.createDataFrame(
        [("WHATEVER,seg,v",), ("1,,",), ("2,NA,NA",), ("3,MMM,1.5",)], "value string"
    ).coalesce(1).write.text(path)
    got = rows(io.read_panel(spark, path, schema).fillna({"v": -1.0}).fillna("<null>"))
    assert got == [(1, "", -1.0), (2, "<null>", -1.0), (3, "MMM", 1.5)]


def test_year_files(spark):
    """The year comes from the name; Spark writes a folder of that name."""
    root = scratch_path(spark, "byfile")
    schema = T.StructType([T.StructField("K", T.LongType()), T.StructField("t", T.StringType())])
    for y in (2017, 2018):
        spark.createDataFrame([(y % 100, "a")], "K long, t string").write.option(
            "header", True
        ).csv(f"{root}/im{y}_utf8.csv")
    df = io.read_year_files(spark, root + "/im{year}_utf8.csv", schema, [2017, 2018])
    assert rows(df, "id", "t", "year") == [(17, "a", 2017), (18, "a", 2018)]


def test_strict_sum_spares_unknown(spark):
    df = spark.createDataFrame(
        [(1, 2018, 1)] * 11 + [(1, 2018, None)] + [(2, 2018, 1)] * 11 + [(2, 2018, 0)],
        "id long, year int, flag int",
    )
    got = {r.id: r.s for r in df.groupBy("id").agg(strict_sum("flag").alias("s")).collect()}
    assert got == {1: None, 2: 11}
    assert {r.id for r in ex.exclude_young(df, "flag", 12).collect()} == {1}


PANEL = "id long, period date, year int, status int, sector string, active int, a double"


def _panel(spark, data):
    return spark.createDataFrame(
        [(i, month(p), int(p[:4]), s, x, 1 if act else 0, a) for i, p, s, x, act, a in data], PANEL
    )


def test_exemption_reaches_back(spark):
    df = _panel(
        spark,
        [(1, f"{y}-12", 5 if y == 2017 else None, "A", True, 1.0) for y in (2015, 2016, 2017, 2018)]
        + [(2, "2015-12", None, "A", True, 1.0)],
    )
    exempt = ex.exempt_ids(df, F.col("status") == 5)
    kept = rows(ex.exclude_young(df, "active", 2, exempt), "id", "year")
    assert kept == [(1, 2015), (1, 2016), (1, 2017)]


def test_clean_rows_equals_the_steps(spark):
    data = [
        (1, "2017-11", None, "A", True, 1.0), (1, "2017-12", 5, "X", True, 1.0),
        (2, "2017-11", None, "A", True, 1.0), (2, "2017-12", None, "A", True, None),
        (3, "2017-11", None, "A", True, 1.0), (3, "2017-10", None, "A", False, None),
        (4, "2017-11", None, "A", True, None), (4, "2017-12", None, "A", True, None),
        (4, "2018-12", 5, "A", True, None),
        (5, "2017-11", None, "A", True, 2.0), (5, "2017-12", None, None, True, 2.0),
    ]
    df = _panel(spark, data)
    event, unclear = F.col("status") == 5, F.col("sector") == "X"
    exempt = ex.exempt_ids(df, event)
    steps = ex.exclude_no_annual(
        ex.exclude_young(ex.exclude_any(df, unclear), "active", 2, exempt), ["a"], exempt
    )
    once = ex.clean_rows(df, event, unclear, "active", ["a"], 2)
    assert rows(once, "id", "period") == rows(steps, "id", "period")
    # X drops the event company too; an empty December drops 2; 3 is young; 4 is exempt.
    assert {r.id for r in once.collect()} == {4, 5}


def test_truncate_keeps_first_event_only(spark):
    df = spark.createDataFrame(
        [(1, month(f"2018-{m:02d}"), 5 if m in (3, 6) else None) for m in range(1, 9)]
        + [(2, month("2016-01"), None), (3, month("2015-05"), 5), (3, month("2016-05"), None)],
        "id long, period date, status int",
    )
    got = rows(tl.truncate_after_event(df, F.col("status") == 5), "id", "period")
    assert [p.month for i, p in got if i == 1] == [1, 2, 3]
    assert [(i, p.year) for i, p in got if i > 1] == [(2, 2016), (3, 2015)]


def test_dedupe_uses_declared_order(spark):
    df = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (2, 1, "c")], "id long, o int, v string")
    assert rows(tl.dedupe(df, ["id"], [F.col("o")]), "id", "v") == [(1, "a"), (2, "c")]


@pytest.mark.parametrize(
    "values,expect",
    [((1.0, 1.0, 1.0, 1.0, 1.0, 0.0, 1.0), 2.75), ((0.0, 0.0, 0.0, 0.0, 0.0, 5.0, 5.0), 2.75),
     ((1.0, 1.0, 1.0, 1.0, 1.0, 1.0, None), 2.75), ((1.0, 1.0, 1.0, 1.0, 1.0, 2.0, 4.0), 3.595)],
)
def test_ratio_score(spark, values, expect):
    cols = ["working_capital", "net_profit", "pretax_profit", "equity", "revenue", "total_assets",
            "liabilities"]
    df = spark.createDataFrame([values], ", ".join(f"{c} double" for c in cols))
    terms = [
        (1.2, "working_capital", "total_assets"), (1.4, "net_profit", "total_assets"),
        (3.3, "pretax_profit", "total_assets"), (0.6, "equity", "liabilities"),
        (0.99, "revenue", "total_assets"),
    ]
    assert df.select(pj.ratio_score(terms)).head()[0] == pytest.approx(expect)


def test_impute_only_from_losses(spark):
    df = spark.createDataFrame(
        [(1, None, -5.0), (2, None, 5.0), (3, None, None), (4, 7.0, -1.0)],
        "id long, pre double, net double",
    )
    got = rows(pj.fill_all(pj.impute_from(df, "pre", "net", F.col("net") <= 0)), "id", "pre")
    assert got == [(1, -5.0), (2, 0.0), (3, 0.0), (4, 7.0)]


def test_currency_before_changeover(spark):
    df = spark.createDataFrame([(2014, 3.45), (2015, 3.45)], "year int, m double")
    assert [r.m for r in pj.convert_currency(df, ["m"]).orderBy("year").collect()] == [1.0, 3.45]


def test_unmapped_category_stays_and_equal_ratios_have_no_rank(spark):
    risk = spark.createDataFrame([("a", 0.1), ("b", 0.1)], "category string, ratio double")
    assert [r["rank"] for r in pr.risk_rank(risk).collect()] == [None, None]
    ranks = spark.createDataFrame([("a", 3)], "category string, rank int")
    df = spark.createDataFrame([(1, "a"), (2, "z"), (3, None)], "id long, c string")
    assert {r.id: r.c for r in pj.map_category(df, "c", ranks).collect()} == {1: "3", 2: "z", 3: None}


def test_map_category_without_broadcast(spark):
    ranks = spark.createDataFrame([(f"c{i}", i) for i in range(50)], "category string, rank int")
    df = spark.range(2000).select("id", F.when(F.col("id") < 1500, "c1").otherwise(
        F.concat(F.lit("c"), F.col("id") % 60)).alias("c"))
    wide = pj.map_category(df, "c", ranks, salts=4)
    plain = pj.map_category(df, "c", ranks)
    assert rows(wide) == rows(plain)


def test_sparse_columns(spark):
    df = spark.range(100).select(
        "id", F.when(F.col("id") == 0, 1).alias("one"), F.when(F.col("id") < 3, 1).alias("three")
    )
    assert pj.drop_sparse(df, 0.98).columns == ["id", "three"]


def test_wide_row_rule_plans_quickly(spark):
    """A rule over many computed cells must not blow up the optimizer."""
    cells = [F.coalesce(F.col("id"), F.lit(i)).alias(f"c{i}") for i in range(60)]
    df = spark.range(3).select(*cells)
    kept = pj.complete_cases(pj.drop_empty_rows(df, df.columns, 59))
    assert kept.count() == 2


def test_healthy_pool_scopes(spark):
    ids = spark.createDataFrame(
        [(1, dt.date(2018, 3, 1)), (2, dt.date(2018, 3, 1)), (3, dt.date(2018, 3, 1))],
        "id long, event date",
    )
    events = spark.createDataFrame(
        [(1, dt.date(2018, 9, 1)), (2, dt.date(2016, 3, 1))], "id long, event date"
    )
    assert rows(ex.healthy_pool(ids, events, "ever"), "id") == [(3,)]
    assert rows(ex.healthy_pool(ids, events, "year"), "id") == [(2,), (3,)]
    assert rows(ex.healthy_pool(ids, events, "month"), "id") == [(1,), (3,)]


def test_year_folders_are_pruned_and_parts_bounded(spark):
    path = scratch_path(spark, "folders")
    schema = T.StructType([T.StructField("K", T.LongType()), T.StructField("v", T.DoubleType())])
    df = spark.range(90).select(
        F.col("id").alias("K"), F.lit(1.5).alias("v"), (2015 + F.col("id") % 3).alias("year")
    )
    io.write_panel(df.coalesce(1), path, by=["year"], fmt="csv", max_records=10)
    one = io.read_years(spark, path, schema, [2016])
    assert one.count() == 30 and one.columns[0] == "id"
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(year" in plan
    assert one.select("_metadata.file_path").distinct().count() == 3


def test_results_are_written_per_model(spark):
    path = scratch_path(spark, "results")
    df = spark.createDataFrame([("a", 1, 0.5), ("b", 2, 0.7)], "model string, id int, score double")
    for _ in range(2):
        io.write_results(df, path, by=["model"])
    assert rows(spark.read.parquet(path), "model", "id", "score") == rows(df)
