"""Confusion counts, metrics, thresholds and curves on the score set."""

from __future__ import annotations

from pyspark.sql import functions as F

from duskline.evaluation import confusion as cf, curves as cv
from duskline.operators.sampling import assign_folds
from duskline.plans import fixtures as fx
from duskline.plans.catalog import query
from duskline.plans.oracle_views import seeded, slot_of

SWEEP = [0.2, 0.4, 0.6, 0.8]


def _cells(t: str) -> str:
    return ", ".join(
        f"count(*) FILTER (WHERE {a}score >= {t} AND {b}target = 1) AS {n}"
        for n, a, b in [("tp", "", ""), ("fp", "", "NOT "), ("fn", "NOT ", ""), ("tn", "NOT ", "NOT ")]
    )


_SIX = """round(tp / nullif(tp + fn, 0), 6) AS sensitivity, round(tn / nullif(tn + fp, 0), 6) AS specificity,
round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall,
CASE WHEN tp + fp > 0 THEN round(2 * tp / (2 * tp + fp + fn), 6) END AS f1,
round((tp / nullif(tp + fn, 0) + tn / nullif(tn + fp, 0)) / 2, 6) AS balanced_accuracy"""
_PE = "(((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn)) / ((tp + fp + fn + tn) * (tp + fp + fn + tn)))"
_PO = "((tp + tn) / (tp + fp + fn + tn))"


@query(
    "spread_scores",
    """SELECT id, target, max(CASE WHEN model = 'bal' THEN score END) AS bal,
max(CASE WHEN model = 'price' THEN score END) AS price FROM S GROUP BY 1, 2""",
)
def spread_scores(spark, sf):
    return cf.spread_scores(fx.scores(spark, sf), ["bal", "price"], ["id"])


@query("confusion", f"SELECT model, {_cells('0.9')} FROM S GROUP BY 1")
def confusion(spark, sf):
    return cf.confusion(fx.scores(spark, sf), 0.9)


@query(
    "class_metrics", f"SELECT *, {_SIX} FROM C", f"C AS (SELECT model, {_cells('0.9')} FROM S GROUP BY 1)"
)
def class_metrics(spark, sf):
    return cf.class_metrics(cf.confusion(fx.scores(spark, sf), 0.9))


@query(
    "class_report",
    f"""SELECT *, {_SIX}, round(tp / nullif(tp + fp, 0), 6) AS pos_pred_value,
round(tn / nullif(tn + fn, 0), 6) AS neg_pred_value, round((tp + fn) / n, 6) AS prevalence,
round(tp / n, 6) AS detection_rate, round((tp + fp) / n, 6) AS detection_prevalence,
round({_PO}, 6) AS accuracy, round(greatest((tp + fn) / n, (fp + tn) / n), 6) AS no_information_rate,
round(({_PO} - {_PE}) / nullif(1 - {_PE}, 0), 6) AS kappa,
CASE WHEN fp + fn > 0 THEN round((abs(fp - fn) - 1) * (abs(fp - fn) - 1) / (fp + fn), 6) END AS mcnemar
FROM C""",
    f"C AS (SELECT model, month, {_cells('0.9')}, count(*) AS n FROM S GROUP BY 1, 2)",
)
def class_report(spark, sf):
    cm = cf.confusion(fx.scores(spark, sf), 0.9, ["model", "month"])
    cm = cm.withColumn("n", F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn"))
    return cf.class_metrics(cm, full=True)


_GRID = f"""
G AS (SELECT model, k / CAST(100 AS DOUBLE) AS threshold, {_cells("k / CAST(100 AS DOUBLE)")}
      FROM S CROSS JOIN (SELECT unnest(generate_series(0, 100)) AS k) GROUP BY 1, 2)"""
_CRITERIA = {
    "youden": "tp / nullif(tp + fn, 0) + tn / nullif(tn + fp, 0)",
    "kappa": f"({_PO} - {_PE}) / nullif(1 - {_PE}, 0)",
    "f1": "CASE WHEN tp + fp > 0 THEN 2 * tp / (2 * tp + fp + fn) END",
}


def _best(method: str) -> str:
    return f"""SELECT model, threshold, round(value, 6) AS value FROM (
  SELECT model, threshold, value, row_number() OVER (PARTITION BY model ORDER BY value DESC, threshold) AS rn
  FROM (SELECT model, threshold, round({_CRITERIA[method]}, 9) AS value FROM G) WHERE value IS NOT NULL)
WHERE rn = 1"""


@query("threshold_youden", _best("youden"), _GRID)
def threshold_youden(spark, sf):
    return cv.best_threshold(fx.scores(spark, sf), "youden")


@query("threshold_kappa", _best("kappa"), _GRID)
def threshold_kappa(spark, sf):
    return cv.best_threshold(fx.scores(spark, sf), "kappa")


@query("threshold_f1", _best("f1"), _GRID)
def threshold_f1(spark, sf):
    return cv.best_threshold(fx.scores(spark, sf), "f1")


@query(
    "threshold_mean",
    f"SELECT round(avg(threshold), 4) AS threshold, count(*) AS models FROM ({_best('kappa')})",
    _GRID,
)
def threshold_mean(spark, sf):
    return cv.mean_threshold(cv.best_threshold(fx.scores(spark, sf), "kappa"))


@query(
    "threshold_sweep",
    f"SELECT *, {_SIX} FROM C",
    f"""C AS (SELECT model, month, CAST(t AS DOUBLE) AS threshold, {_cells("t")} FROM S
CROSS JOIN (SELECT CAST(unnest({SWEEP}) AS DOUBLE) AS t) GROUP BY 1, 2, 3)""",
)
def threshold_sweep(spark, sf):
    return cf.class_metrics(cf.threshold_sweep(fx.scores(spark, sf), SWEEP, ["model", "month"]))


_MONTH_METRICS = f"""
C AS (SELECT model, month, {_cells('0.5')} FROM S GROUP BY 1, 2),
CM AS (SELECT *, {_SIX} FROM C)"""


@query(
    "metric_table",
    "SELECT model, metric, "
    + ", ".join(f"max(CASE WHEN month = {m} THEN value END) AS month_{m}" for m in range(1, 13))
    + " FROM ("
    + " UNION ALL ".join(
        f"SELECT model, month, '{m}' AS metric, {m} AS value FROM CM" for m in cf.KEPT_METRICS
    )
    + ") GROUP BY 1, 2",
    _MONTH_METRICS,
)
def metric_table(spark, sf):
    wide = cf.compare_models(fx.scores(spark, sf), 0.5, ["month"])
    long = cf.long_metrics(wide, ["model", "month"])
    return cf.metric_table(long, "month", list(range(1, 13)), ["model"], "month_")


@query("compare_models", "SELECT * FROM CM", _MONTH_METRICS)
def compare_models(spark, sf):
    return cf.compare_models(fx.scores(spark, sf), 0.5, ["month"])


_POINTS = """
HI AS (SELECT model, score, sum(target) AS p, sum(1 - target) AS n FROM S GROUP BY 1, 2),
CU AS (SELECT model, score, p, n, sum(p) OVER w AS tp, sum(n) OVER w AS fp,
              sum(p) OVER (PARTITION BY model) AS pos, sum(n) OVER (PARTITION BY model) AS neg
       FROM HI WINDOW w AS (PARTITION BY model ORDER BY score DESC))"""


@query("roc_curve", "SELECT model, score, round(fp / neg, 6) AS fpr, round(tp / pos, 6) AS tpr FROM CU", _POINTS)
def roc_curve(spark, sf):
    return cv.roc_curve(fx.scores(spark, sf))


@query(
    "roc_auc",
    """SELECT a.model, round(avg(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0 END), 6) AS auc
FROM S a JOIN S b ON a.model = b.model WHERE a.target = 1 AND b.target = 0 GROUP BY 1""",
    _POINTS,
)
def roc_auc(spark, sf):
    return cv.auc(fx.scores(spark, sf))


@query(
    "det_curve", "SELECT model, score, round(fp / neg, 6) AS fpr, round((pos - tp) / pos, 6) AS fnr FROM CU", _POINTS
)
def det_curve(spark, sf):
    return cv.det_curve(fx.scores(spark, sf))


@query(
    "det_eer",
    """SELECT model, score AS threshold, round((fpr + fnr) / 2, 6) AS eer FROM (
  SELECT *, row_number() OVER (PARTITION BY model ORDER BY round(abs(fpr - fnr), 6), score DESC) AS rn FROM (
    SELECT model, score, round(fp / neg, 6) AS fpr, round((pos - tp) / pos, 6) AS fnr FROM CU)) WHERE rn = 1""",
    _POINTS,
)
def det_eer(spark, sf):
    return cv.eer(fx.scores(spark, sf))


@query(
    "pr_curve",
    "SELECT model, score, round(tp / pos, 6) AS recall, round(tp / (tp + fp), 6) AS precision FROM CU",
    _POINTS,
)
def pr_curve(spark, sf):
    return cv.pr_curve(fx.scores(spark, sf))


@query(
    "best_fold",
    f"""SELECT model, fold, error FROM (
  SELECT *, row_number() OVER (PARTITION BY model ORDER BY error, fold) AS rn FROM (
    SELECT model, CAST({slot_of(seeded(repr('101'), 'id'))} % 5 AS INTEGER) AS fold,
           round(avg((score - target) * (score - target)), 10) AS error FROM S GROUP BY 1, 2)) WHERE rn = 1""",
)
def best_fold(spark, sf):
    return cf.best_fold(assign_folds(fx.scores(spark, sf), 5, fx.SEED, ["id"]))
