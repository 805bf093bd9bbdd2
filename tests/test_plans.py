"""What the physical plans must not contain."""

import pytest

from duskline.plans import load

QUERIES, _ = load()
CHECKED = [
    "clean_rows", "truncate_after_event", "lag_features", "lag_features_dense", "annual_features",
    "match_controls", "downsample", "one_per_id", "category_risk", "threshold_kappa", "det_eer",
    "monthly_sets", "ratio_sets", "class_balance", "yearly_combine",
]


def _plan(spark, df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", CHECKED)
def test_no_python_and_no_cross_join(spark, tiny, name):
    plan = _plan(spark, QUERIES[name](spark, tiny))
    for bad in ["EvalPython", "CartesianProduct", "NestedLoopJoin"]:
        assert bad not in plan


def test_filters_and_columns_reach_the_scan(spark, tiny):
    plan = _plan(spark, QUERIES["event_counts"](spark, tiny))
    assert "PushedFilters: [IsNotNull(o_orderstatus)" in plan
    assert "o_orderpriority" not in plan


def test_clean_rows_scans_the_panel_twice_at_most(spark, tiny):
    plan = _plan(spark, QUERIES["clean_rows"](spark, tiny))
    # facts and kept rows, each from orders and customers
    assert plan.split("Subquery")[0].count("FileScan") <= 4
