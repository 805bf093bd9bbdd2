import numpy as np
import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import functions as F

from duskline.evaluation import confusion as cf, curves as cv


@pytest.fixture(scope="module")
def scores(spark):
    rng = np.random.default_rng(3)
    data = []
    for i in range(400):
        y = int(rng.random() < 0.2)
        data.append((i, "m", float(np.clip(rng.normal(0.4 + 0.2 * y, 0.2), 0, 1).round(2)), y))
    return spark.createDataFrame(data, "id long, model string, score double, target int").cache()


def test_grid_counts_equal_direct_comparison(scores):
    grid = {round(r.threshold, 2): (r.tp, r.fp, r.fn, r.tn) for r in cv.grid_counts(scores).collect()}
    assert len(grid) == 101
    for t in (0.0, 0.07, 0.29, 0.57, 0.58, 1.0):
        c = cf.confusion(scores, t).head()
        assert grid[t] == (c.tp, c.fp, c.fn, c.tn)


@pytest.mark.parametrize("method", ["youden", "kappa", "f1"])
def test_best_threshold_is_lowest_maximum(scores, method):
    best = cv.best_threshold(scores, method).head()
    pdf = scores.toPandas()
    found = []
    for k in range(101):
        hit, y = pdf.score >= k / 100, pdf.target == 1
        tp, fp = (hit & y).sum(), (hit & ~y).sum()
        fn, tn = (~hit & y).sum(), (~hit & ~y).sum()
        n = len(pdf)
        if method == "youden":
            v = tp / (tp + fn) + tn / (tn + fp)
        elif method == "kappa":
            pe = ((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn)) / n**2
            v = ((tp + tn) / n - pe) / (1 - pe) if pe < 1 else -9
        else:
            v = 2 * tp / (2 * tp + fp + fn) if tp + fp else -9
        found.append(round(float(v), 9))
    assert best.threshold == pytest.approx(found.index(max(found)) / 100)
    assert best.value == pytest.approx(max(found), abs=1e-6)


def test_auc_equals_evaluator_and_ignores_monotone_scaling(scores):
    auc = cv.auc(scores).head().auc
    area = BinaryClassificationEvaluator(rawPredictionCol="score", labelCol="target", numBins=0)
    assert auc == pytest.approx(area.evaluate(scores), abs=1e-6)
    assert cv.auc(scores.withColumn("score", F.col("score") / 2)).head().auc == pytest.approx(auc)


def test_perfect_and_useless_models(spark):
    df = spark.createDataFrame(
        [(i, m, s, y) for i, y in enumerate([0, 0, 1, 1]) for m, s in [("p", float(y)), ("c", 0.5)]],
        "id long, model string, score double, target int",
    )
    assert {r.model: r.auc for r in cv.auc(df).collect()} == {"p": 1.0, "c": 0.5}
    assert {r.model: r.eer for r in cv.eer(df).collect()}["p"] == 0.0


def test_undefined_metrics_are_null(scores):
    m = cf.class_metrics(cf.confusion(scores, 1.01), full=True).head()
    assert m.precision is None and m.f1 is None and m.sensitivity == 0.0 and m.specificity == 1.0
    assert m.kappa == 0.0


def test_sweep_equals_single_thresholds(scores):
    swept = {r.threshold: (r.tp, r.fp) for r in cf.threshold_sweep(scores, [0.2, 0.6]).collect()}
    for t in (0.2, 0.6):
        c = cf.confusion(scores, t).head()
        assert swept[t] == (c.tp, c.fp)


def test_best_fold_tie_goes_low(spark):
    df = spark.createDataFrame(
        [("m", f, 0.5, 1) for f in (2, 1, 0)] + [("m", 3, 0.1, 1)],
        "model string, fold int, score double, target int",
    )
    assert cf.best_fold(df).head().fold == 0
