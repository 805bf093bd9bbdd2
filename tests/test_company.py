"""The study on a raw panel in the raw layout, derived from the order tables."""

import pytest
from pyspark.sql import functions as F

from duskline.operators.features import annual_names, lag_names
from duskline.plans import company as co, company_queries as cq
from duskline.sources.scratch import settle


@pytest.fixture(scope="module")
def raw(spark, tiny):
    """Customers as companies, orders as monthly figures, written once."""
    return settle(cq.raw_rows(spark, tiny), "raw")


@pytest.fixture(scope="module")
def panel(raw):
    dated = settle(co.with_period(raw), "dated")
    ranks = {c: settle(co.category_ranks(dated, c)) for c in ("VKR_SEKCIJA", "APS")}
    return settle(co.clean_columns(co.clean_rows(dated), ranks), "panel")


def test_clean_panel(raw, panel):
    assert panel.filter(F.col("id") % 29 == 0).isEmpty()
    assert not {"GRUPE", "SEGMENTAS", "APS", "VKR_SEKCIJA", "always_empty"} & set(panel.columns)
    assert {"SEGMENTAS_MMM", "laik_tipas_pvm_P", "Z_score"} <= set(panel.columns)
    dummies = [c for c in panel.columns if c.startswith("APS_R")]
    assert dummies
    one = panel.agg(*[F.max(c) for c in dummies]).head()
    assert set(one) <= {0, 1}
    after = panel.filter(F.col("KODAS_STATUSAI") == 5).groupBy("id").count().filter("count > 1")
    assert after.isEmpty()
    empty = panel.filter(F.col("B_TURTO_IS_VISO") == 0)
    assert empty.filter(F.col("Z_score") != 2.75).isEmpty()
    # 1.2*1.5/TA + .. on the years after the changeover; before it every figure is divided
    early = panel.filter("year < 2015 and likutis > 0").head()
    full = raw.filter((F.col("id") == early.id) & (F.col("DATE") == early.DATE)).head()
    assert early.likutis == pytest.approx(full.likutis / 3.45)


def test_event_rows_and_ratio_sets(panel):
    events = settle(co.event_rows(panel, 1995), "events")
    assert events.count()
    assert len(events.columns) == 2 + len(co.Blocks.of(panel).features()) + 1
    for scope in ("ever", "year"):
        sets = settle(co.ratio_sets(panel, events, [1, 2], 2000, scope=scope), "sets")
        assert sets.groupBy("ratio", "id", "event").count().filter("count > 1").isEmpty()
        assert set(lag_names(["VADOV_POK"])).isdisjoint(sets.columns)
        quota = {r.event: r["count"] for r in events.groupBy("event").count().collect()}
        drawn = sets.filter("status = 0").groupBy("ratio", "event").count().collect()
        assert drawn and all(r["count"] <= r.ratio * quota[r.event] for r in drawn)
        if scope == "ever":
            bad = sets.filter("status = 0").join(events.select("id"), "id", "left_semi")
            assert bad.isEmpty()


def test_monthly_sets(panel):
    events = co.event_rows(panel, 1995)
    sets = settle(co.monthly_sets(panel, events, [1999, 2000], 2000), "monthly")
    assert {r.split for r in sets.select("split").distinct().collect()} == {"train", "test"}
    assert sets.filter(F.month("event") != F.col("month")).isEmpty()
    assert set(annual_names(["laik_tipas_pvm_M"])).isdisjoint(sets.columns)


def test_monthly_sets_do_not_move_wide_rows(spark, panel):
    events = settle(co.event_rows(panel, 1995), "events")
    years = [1999, 2000]
    blocks = co.Blocks.of(panel, healthy=True)
    sets = co.monthly_sets(panel, events, years, 2000)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = co.monthly_sets(panel, events, years, 2000)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Exchange" not in plan[: plan.index("Window [")]
    # The same controls by joins with the wide rows.
    lags = co.ft.lag_features_dense(panel, blocks.monthly).withColumn("year", F.year("event"))
    lags = lags.filter(F.col("year").isin(years)).join(panel.select("id", "year").distinct(), ["id", "year"], "left_semi")
    wide = co.ft.annual_features(lags.drop("year"), co.statements(panel, blocks), blocks.annual)
    cells = blocks.features()
    healthy = co.pj.drop_empty_rows(wide, cells, len(cells) - 1).withColumn("status", F.lit(0))
    want = co.ds.monthly_sets(healthy, co.shared(events), 2000)
    key = [F.count("*"), F.sum(F.xxhash64(*sorted(want.columns)).cast("decimal(38,0)"))]
    assert sets.agg(*key).first() == want.agg(*key).first()


def test_raw_files_are_laid_out_on_every_core(spark, tiny, monkeypatch):
    monkeypatch.setattr(cq, "COMPANIES_A_TASK", 15)
    companies = cq.fx.customers(spark, tiny)
    files = cq.raw_files(spark, tiny)
    paths = [p.rsplit("/", 1)[1] for p in files.inputFiles()]
    assert len(paths) > 8 and all(p.endswith(".csv.gz") for p in paths)
    plain = cq.raw_rows(spark, tiny).select("id", "DATE")
    again = plain.filter("id % 7 = 0")
    undated = companies.filter("id % 5 = 0").withColumn("DATE", F.lit("no date"))
    want = plain.unionByName(again).unionByName(undated)
    key = [F.count("*"), F.sum(F.xxhash64("id", "DATE").cast("decimal(38,0)"))]
    assert files.agg(*key).first() == want.agg(*key).first()


def test_no_customer_is_joined_after_the_months_are_laid_out(spark, tiny):
    """That join would broadcast all customers: their file is small, their rows are not."""
    plan = cq.raw_rows(spark, tiny)._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.index("Generate") < plan.index("Join") and plan.count("Join ") == 1
