import pytest
from pyspark.sql import functions as F

from duskline.models import forest as fr
from duskline.plans import load
from duskline.plans.sampling_queries import RATIOS, case_control

QUERIES, _ = load()


@pytest.mark.parametrize("name", ["forest_scores", "forest_weighted", "smote_folds"])
def test_scores_are_probabilities(spark, tiny, name):
    df = QUERIES[name](spark, tiny).toPandas()
    assert len(df) and df.score.between(0, 1).all()


def test_cross_scores_cover_every_row_once_and_repeat(spark, tiny):
    a = QUERIES["cross_scores"](spark, tiny).toPandas().sort_values("id")
    b = QUERIES["cross_scores"](spark, tiny).toPandas().sort_values("id")
    assert len(a) and a.score.between(0, 1).all()
    assert a.id.is_unique and a.score.tolist() == b.score.tolist()


def test_saved_model_scores_the_same(spark, tiny):
    df = QUERIES["model_roundtrip"](spark, tiny)
    assert df.count() and df.filter(~F.col("same")).isEmpty()


def test_importances_sum_to_one(spark, tiny):
    df = QUERIES["importance_matrix"](spark, tiny).toPandas()
    assert len(df) == 40
    sums = df.drop(columns="variable").sum()
    assert all(s == pytest.approx(1) or s == 0 for s in sums)


def test_sweep_and_tuning_shapes(spark, tiny):
    models = {f"DISB_{r}" for r in RATIOS}
    assert {"threshold", "month", "metric"} | models == set(QUERIES["ratio_sweep"](spark, tiny).columns)
    grid = QUERIES["tune_forest"](spark, tiny).toPandas()
    assert len(grid) == 4 and (grid.log_loss > 0).all()


@pytest.mark.parametrize("name, sweep", [("month_models", "month_sweep"), ("ratio_sweep", "sweep")])
def test_sweeps_use_every_feature_of_case_control(spark, tiny, monkeypatch, name, sweep):
    class Reached(Exception):
        pass

    prepare = fr.prepare
    made = []

    def record(rows, names, *more):
        made.append((set(names), rows))
        return prepare(rows, names, *more)

    def stop(*args, **more):
        raise Reached

    monkeypatch.setattr(fr, "prepare", record)
    monkeypatch.setattr(fr, sweep, stop)
    with pytest.raises(Reached):
        QUERIES[name](spark, tiny)
    (names, rows) = made[0]
    cases = case_control(spark, tiny)
    assert names == set(cases.columns) - {"id", "event", "status"} and len(names) == 40
    # An event has the cells it has there, controls have annual values as well.
    cells = ["id", "event", *sorted(names)]
    events = lambda df: {tuple(r) for r in df.filter("status = 1").select(*cells).collect()}
    assert events(rows) == events(cases) != set()
    assert not rows.filter("status = 0 AND sales_Y_1 <> 0").isEmpty()


def test_months_without_two_classes_have_the_year_only(spark):
    rows = [
        (i, f"{1999 + (i % 4 == 0)}-{m:02d}-01", m, "test" if i % 4 == 0 else "train", int(i % 8 < 2 and m < 3), float(i % 8))
        for m in (1, 2, 3) for i in range(40)
    ]
    df = spark.createDataFrame(rows, "id long, event string, month int, split string, status int, x double")
    df = fr.prepare(df, ["x"], ["id", "event", "month", "split", "status"])
    oof, tested, models = fr.month_sweep(df, 1, 2, 2, fr.ForestParams(trees=5, columns=1, min_child_rows=1))
    assert set(models) == {"1", "2", "year"} and all(len(m) == 2 for m in models.values())
    scored = {(r["model"], r["month"]): r["n"] for r in tested.groupBy("model", "month").agg(F.count("*").alias("n")).collect()}
    assert scored == {("1", 1): 10, ("2", 2): 10, ("year", 1): 10, ("year", 2): 10, ("year", 3): 10}
    # Two months with ten event rows in training: each keeps these and at most two controls per event.
    n = {r["model"]: (r["n"], r["e"]) for r in oof.groupBy("model").agg(F.count("*").alias("n"), F.sum("target").alias("e")).collect()}
    events = sum(1 for r in rows if r[3] == "train" and r[4] and r[2] == 1)
    spare = sum(1 for r in rows if r[3] == "train" and not r[4] and r[2] == 1)
    kept = events + min(2 * events, spare)
    assert n == {"1": (kept, events), "2": (kept, events), "year": (2 * kept, 2 * events)}


def test_best_model_follows_error(spark):
    df = spark.createDataFrame(
        [("m", 0, 0.9, 0), ("m", 1, 0.1, 0)], "model string, fold int, score double, target int"
    )
    assert fr.best_model(df, ["a", "b"]) == (1, "b")


def test_a_fit_uses_several_tasks_whatever_the_order_of_its_rows(spark, monkeypatch):
    monkeypatch.setattr(fr, "ROWS_A_TASK", 60, raising=False)
    cells = spark.range(0, 240, 1, 1).selectExpr("id", "CAST(id % 7 < 3 AS INT) AS status", "CAST(id % 11 AS DOUBLE) AS x")
    df = fr.prepare(cells, ["x"], ["id", "status"])
    params = fr.ForestParams(trees=4, columns=1, min_child_rows=5, depth=4)
    scores = []
    for order in (F.col("id"), F.col("id").desc()):
        model = fr.fit_forest(df.coalesce(1).sortWithinPartitions(order), 1, params=params)
        scores.append(sorted(map(tuple, fr.score(model, df, ["id"]).collect())))
    assert scores[0] == scores[1] and len(scores[0]) == 240
    dealt = fr.dealt_rows(df.select("features", "status").coalesce(1))
    assert dealt.rdd.getNumPartitions() == 4 and dealt.count() == 240


def test_derived_training_rows_are_made_once(spark, monkeypatch):
    monkeypatch.setattr(fr, "ROWS_A_TASK", 10, raising=False)
    made = spark.sparkContext.accumulator(0)

    def add(x):
        made.add(1)
        return x

    again = F.udf(add, "int").asNondeterministic()
    rows = [(i, i % 2, float(i % 5)) for i in range(40)]
    df = fr.prepare(spark.createDataFrame(rows, "id long, status int, x double"), ["x"], ["id", "status"])
    params = fr.ForestParams(trees=2, columns=1, min_child_rows=1, depth=2)
    fr.cross_scores(df, 1, 2, params=params, rebalance=lambda t: t.withColumn("status", again("status")))
    assert made.value == 40
