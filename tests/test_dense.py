import datetime as dt
from itertools import takewhile

import pytest

from duskline.plans import fixtures as fx, load

QUERIES, _ = load()


@pytest.fixture
def orders_dir(spark, tmp_path):
    """Customer 1 twice, a customer without orders, one without a key, an order without a date."""

    def day(month):
        return None if month is None else dt.datetime(2000, month, 5)

    orders = [(1, 1, 1), (2, 1, 1), (3, 1, 3), (4, 2, 3), (5, 2, None), (6, 9, 2), (7, None, 2)]
    orders = [(k, c, "F", 10.0, day(m), "1-URGENT") for k, c, m in orders]
    spark.createDataFrame(orders, fx.SCHEMAS["orders"]).write.parquet(f"{tmp_path}/orders.parquet")
    customers = [(c, "c", 1, 0.0, "A") for c in (1, 1, 2, 3, None)]
    spark.createDataFrame(customers, fx.SCHEMAS["customer"]).write.parquet(f"{tmp_path}/customer.parquet")
    return str(tmp_path)


def test_dense_panel_has_every_month_of_every_customer_row(spark, orders_dir):
    got = [(r["id"], r["period"].month, r["n"], r["active"]) for r in fx.dense_panel(spark, orders_dir).collect()]
    n = {(1, 1): 2, (1, 3): 1, (2, 3): 1}
    want = [(c, m, n.get((c, m)), int((c, m) in n)) for c in (1, 1, 2, 3, None) for m in (1, 2, 3)]
    assert sorted(got, key=str) == sorted(want, key=str)


@pytest.mark.parametrize("name", ["complete_cases", "exclude_no_annual", "strict_sum"])
def test_the_calendar_is_laid_out_after_the_join(spark, orders_dir, name):
    """An exploded calendar has the size estimate of the customers, so a join would broadcast it."""
    plan = QUERIES[name](spark, orders_dir)._jdf.queryExecution().optimizedPlan()
    lines = [(len(x) - len(x.lstrip(" :+-")), x.lstrip(" :+-")) for x in plan.toString().splitlines()]
    laid_out = [i for i, (_, x) in enumerate(lines) if x.startswith("Generate")]
    assert laid_out
    for i in laid_out:
        below = takewhile(lambda line: line[0] > lines[i][0], lines[i + 1 :])
        assert any(x.startswith("Join") for _, x in below)


def test_the_lists_of_months_are_not_broadcast(spark, orders_dir):
    plan = fx.dense_panel(spark, orders_dir)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
