"""Queries with SQL equal it; every numbered query and the pipeline give whole results."""

import pytest

from duskline.llm.queries import load
from tests.oracle import compare, connect

QUERIES, ORACLES = load()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, tiny, name):
    assert compare(QUERIES[name](spark, tiny), connect(tiny), ORACLES[name]) is None


def test_one_query_per_operator():
    numbers = sorted(int(name[2:].split("_")[0]) for name in QUERIES if name.startswith("op"))
    assert numbers == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if n.split("_")[0] in {"op2", "op4", "op5", "op10"}))
def test_native_queries_run_no_python(spark, tiny, name):
    plan = QUERIES[name](spark, tiny)._jdf.queryExecution().executedPlan().toString()
    for bad in ["EvalPython", "InPandas", "InArrow", "CartesianProduct", "NestedLoopJoin"]:
        assert bad not in plan
