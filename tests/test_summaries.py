"""Co-moments, quantiles and committed parts against plain versions."""

import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from duskline.operators import profiles as pr, summaries as sm
from duskline.sources import parts
from duskline.sources.scratch import scratch_path


@pytest.fixture(scope="module")
def numbers(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(1e6, 1, (3000, 4))
    x[:, 1] += 3 * x[:, 0]
    rows = [(*map(float, r), None if i % 100 == 0 else 1.0 * (i % 7), 5.0, float(i // 1000), None) for i, r in enumerate(x)]
    schema = ", ".join(f"c{i} double" for i in range(8))
    return spark.createDataFrame(rows, schema).repartition(50), rows


def test_pearson_merges_in_any_partitioning(numbers):
    df, rows = numbers
    want = np.corrcoef(np.array([r[:4] for r in rows]).T)
    for d in (df, df.coalesce(1)):
        got = {(a, b): r for a, b, r in sm.pearson(d, [f"c{i}" for i in range(6)])}
        assert np.allclose([[got[f"c{i}", f"c{j}"] for j in range(4)] for i in range(4)], want, atol=1e-9)
        assert got["c0", "c4"] is None and got["c5", "c5"] is None
    assert all(r is None for _, _, r in sm.pearson(df.limit(0), ["c0", "c1"]))
    assert pr.corr_matrix(df, ["c0", "c1"]).filter("a <> b and r = 0.95").count() == 2


@pytest.mark.parametrize("few", [10, 100_000])
def test_quantiles_are_exact(numbers, monkeypatch, few):
    df, rows = numbers
    monkeypatch.setattr(sm, "FEW", few)
    monkeypatch.setattr(sm, "SKETCHED", 3)
    shares = [0.0, 0.25, 0.5, 0.9, 1.0]
    cols = [f"c{i}" for i in range(8)]
    got = {(r["column"], r["share"]): r["value"] for r in sm.quantiles(df, cols, shares).collect()}
    assert len(got) == len(cols) * len(shares)
    for i, c in enumerate(cols):
        values = [r[i] for r in rows if r[i] is not None]
        for p in shares:
            assert got[c, p] == (pytest.approx(np.quantile(values, p), rel=1e-12) if values else None)


def test_quantiles_of_nan_and_nothing(spark):
    df = spark.createDataFrame([(float("nan"), 1), (2.0, None), (4.0, 3), (None, 3)], "a double, b int")
    got = {(r["column"], r["share"]): r["value"] for r in sm.quantiles(df, ["a", "b"], [0.5]).collect()}
    assert got == {("a", 0.5): 3.0, ("b", 0.5): 3.0}
    assert [r["value"] for r in sm.quantiles(df.limit(0), ["a"], [0.5]).collect()] == [None]


def test_text_levels(spark):
    df = spark.createDataFrame([("x",), ("x",), (None,), (None,), ("y",), ("z",)], "t string")
    got = [tuple(r) for r in sm.text_levels(df, ["t"], 3).orderBy("rank").collect()]
    assert got == [("t", None, 2, 1), ("t", "x", 2, 2), ("t", "y", 1, 3)]


def test_a_part_is_there_once(spark, monkeypatch):
    root = scratch_path(spark, "parts")
    a, b = spark.range(10).withColumn("v", F.col("id") * 2), spark.range(5).withColumn("w", F.lit("x"))
    with pytest.raises(ValueError):
        parts.read_committed(spark, root)
    assert parts.write_part(a, root, "one", "r1")
    assert not parts.write_part(a.repartition(3), root, "one", "r1")
    content, calls = parts._content, []

    def failing(df):
        calls.append(1)
        if len(calls) == 2:
            raise RuntimeError("lost")
        return content(df)

    monkeypatch.setattr(parts, "_content", failing)
    with pytest.raises(RuntimeError):
        parts.write_part(b, root, "two/%", "r1")
    monkeypatch.setattr(parts, "_content", content)
    assert parts.read_committed(spark, root).count() == 10
    assert parts.write_part(b, root, "two/%", "r1")
    assert parts.write_part(a.filter("id < 3"), root, "one", "r2")
    assert parts.write_part(b.limit(0), root, "none", "r2")
    got = parts.read_committed(spark, root).groupBy("part").count().collect()
    assert sorted(map(tuple, got)) == [("one", 3), ("two/%", 5)]
    assert sorted((r["name"], r["run"], r["rows"]) for r in parts.committed(spark, root).collect()) == [
        ("none", "r2", 0), ("one", "r2", 3), ("two/%", "r1", 5),
    ]


def test_a_part_of_rows_that_change_when_computed_again(spark):
    """What a limit takes of several executors' rows differs from run to run."""
    draw = F.udf(lambda: str(uuid.uuid4())).asNondeterministic()
    root = scratch_path(spark, "changing_parts")
    assert parts.write_part(spark.range(5).withColumn("v", draw()), root, "one", "r1")
    assert parts.read_committed(spark, root).count() == 5
