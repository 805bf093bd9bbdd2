"""Every query with SQL equals that SQL; the others give rows."""

import pytest

from duskline.plans import load
from tests.oracle import compare, connect

QUERIES, ORACLES = load()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, tiny, name):
    diff = compare(QUERIES[name](spark, tiny), connect(tiny), ORACLES[name])
    assert diff is None or diff == "both empty"


def test_every_query_is_known():
    assert set(ORACLES) <= set(QUERIES)
    without = set(QUERIES) - set(ORACLES)
    assert without == {
        "forest_scores", "forest_weighted", "cross_scores", "tune_forest", "importance_matrix",
        "ratio_sweep", "month_models", "smote_folds",
    }
