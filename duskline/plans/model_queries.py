"""Forests, folds, sweeps, importances and synthetic rows.

Fits are not expressible in SQL, so most of these have no SQL equivalent. They run on all
case-control rows, with the library's default trees, folds, ratios and months.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from duskline.evaluation import confusion as cf
from duskline.models import forest as fr
from duskline.models.bagging import fit_bags, in_bag, out_of_bag
from duskline.models.importance import importance_matrix, importances
from duskline.models.study import Study
from duskline.operators import features as ft, sampling as sp
from duskline.operators.smote import smote
from duskline.plans import fixtures as fx
from duskline.plans.catalog import query
from duskline.plans.oracle_views import seeded, slot_of
from duskline.plans.sampling_queries import CASES, RATIOS, case_control, event_rows, matched_ratios, month_rows
from duskline.sources import panel_io as io
from duskline.sources.scratch import scratch_path, settle

BAGS = 10
FEATURES = ft.lag_names(fx.METRICS) + ft.annual_names(fx.ANNUAL)


def _train(spark, sf):
    return fr.prepare(case_control(spark, sf), FEATURES, ["id", "event", "status"])


def _rounded(df):
    return df.withColumn("score", F.round("score", 6))


@query("forest_scores")
def forest_scores(spark, sf):
    """Fit on all years but the test year, score the test year."""
    df = _train(spark, sf)
    year = F.year("event")
    model = fr.fit_forest(df.filter(year != fx.TEST_YEAR), len(FEATURES))
    return _rounded(fr.score(model, df.filter(year == fx.TEST_YEAR), ["id", "event", "status"]))


@query("forest_weighted")
def forest_weighted(spark, sf):
    df = _train(spark, sf)
    year = F.year("event")
    model = fr.fit_weighted(df.filter(year != fx.TEST_YEAR), len(FEATURES))
    return _rounded(fr.score(model, df.filter(year == fx.TEST_YEAR), ["id", "event", "status"]))


@query("cross_scores")
def cross_scores(spark, sf):
    scores, _ = fr.cross_scores(_train(spark, sf), len(FEATURES))
    return _rounded(scores)


@query("tune_forest")
def tune_forest(spark, sf):
    _, results = fr.tune_forest(_train(spark, sf), len(FEATURES), [10, 40], [10, 50])
    return spark.createDataFrame(results, "columns int, child_rows int, log_loss double")


@query(
    "model_roundtrip", "SELECT id, event, status, CAST(1 AS BOOLEAN) AS same FROM AN", CASES
)
def model_roundtrip(spark, sf):
    """Every case scored before saving and after loading: the scores are the same."""
    df = _train(spark, sf)
    model = fr.fit_forest(df, len(FEATURES))
    path = scratch_path(spark, "model")
    io.save_model(model, path)
    before = fr.score(model, df, ["id", "event", "status"], "before")
    after = fr.score(io.load_model(path), df, ["id", "event"], "after")
    return before.join(after, ["id", "event"]).select(
        "id", "event", "status", (F.col("before") == F.col("after")).alias("same")
    )


@query("importance_matrix")
def importance_matrix_query(spark, sf):
    """Importances of each fold's model side by side."""
    _, models = fr.cross_scores(_train(spark, sf), len(FEATURES))
    runs = [f"CV_{i}" for i in range(len(models))]
    long = reduce(
        lambda a, b: a.unionByName(b),
        [importances(spark, m, FEATURES, r) for m, r in zip(models, runs)],
    )
    return importance_matrix(long, runs)


@query(
    "bag_samples",
    f"""
SELECT id, event, CAST(bag AS INTEGER) AS bag,
       {slot_of(seeded("('101 bag ' || bag)", "id", "event"))} % 1000 < 632 AS seen
FROM AN CROSS JOIN (SELECT unnest(range(10)) AS bag)
""",
    CASES,
)
def bag_samples(spark, sf):
    """Which rows each bag of trees learns from."""
    seen = F.array(*[in_bag(b, ["id", "event"]) for b in range(BAGS)])
    return case_control(spark, sf).select("id", "event", F.posexplode(seen).alias("bag", "seen"))


def _study(spark, name, **more):
    return Study(spark, scratch_path(spark, name), len(FEATURES), key=["id", "event"], **{"bags": BAGS} | more)


@query("out_of_bag")
def out_of_bag_query(spark, sf):
    """Each case by the trees that left it out."""
    df = _train(spark, sf)
    key = ["id", "event"]
    models = fit_bags(df, len(FEATURES), BAGS, key)
    return _rounded(out_of_bag(models, df, key))


@query("study_folds")
def study_folds(spark, sf):
    """Every fold's out-of-bag error, and the fold that it picks."""
    study = _study(spark, "study", bags=5)
    study.run({"ALL": _train(spark, sf)})
    best = study.best_folds().select("name", "fold", F.lit(True).alias("best"))
    found = study.manifest().join(best, ["name", "fold"], "left")
    return found.select("name", "fold", "bags", "rows", F.round("error", 6).alias("error"), F.coalesce("best", F.lit(False)).alias("best"))


@query("importance_ratios")
def importance_ratios(spark, sf):
    """Importances of all folds of all ratios, from the saved trees."""
    rows = _ratio_rows(spark, sf).filter(F.year("event") != fx.TEST_YEAR)
    study = _study(spark, "ratio_study")
    study.run({f"DISB_{r}": rows.filter(F.col("ratio") == r).drop("ratio") for r in RATIOS}, parallelism=6)
    return study.importance_cube(FEATURES)


def _ratio_rows(spark, sf, ratios=RATIOS):
    """Events with the controls of every ratio, as vectors."""
    p = fx.settled_panel(spark, sf)
    anchors = matched_ratios(spark, sf, ratios, p).withColumn("status", F.lit(0))
    annual = fx.annual(spark, sf, p)
    controls = ft.feature_rows(settle(anchors, "anchors"), p, fx.METRICS, annual, fx.ANNUAL)
    events = event_rows(spark, sf, p, fx.METRICS, fx.ANNUAL)
    many = F.explode(F.array(*[F.lit(r) for r in ratios]))
    rows = controls.unionByName(events.withColumn("ratio", many))
    return fr.prepare(rows, FEATURES, ["ratio", "id", "event", "status"], "ratios")


@query("ratio_sweep")
def ratio_sweep(spark, sf):
    """Every class ratio x thresholds x test months, as rows of kept metrics."""
    ratios = RATIOS
    rows = _ratio_rows(spark, sf, ratios)
    train = rows.filter(F.year("event") != fx.TEST_YEAR)
    test = rows.filter((F.year("event") == fx.TEST_YEAR) & (F.col("ratio") == max(ratios)))
    sets = {f"DISB_{r}": train.filter(F.col("ratio") == r) for r in ratios}
    _, tested, _ = fr.sweep(
        sets, test.withColumn("month", F.month("event")), len(FEATURES), ["id", "month"]
    )
    cm = cf.threshold_sweep(tested, [0.2, 0.4, 0.6, 0.8], ["model", "month"])
    long = cf.long_metrics(cf.class_metrics(cm), ["model", "month", "threshold"])
    return cf.metric_table(long, "model", list(sets), ["threshold", "month"])


@query("month_models")
def month_models(spark, sf):
    """Each calendar month's model against the year's, on that month of the test year."""
    p = fx.settled_panel(spark, sf)
    sets = month_rows(spark, sf, p, fx.METRICS, fx.ANNUAL)
    rows = fr.prepare(sets, FEATURES, ["id", "event", "month", "split", "status"], "months")
    _, tested, _ = fr.month_sweep(rows, len(FEATURES))
    tested = tested.withColumn("model", F.when(F.col("model") == "year", "year").otherwise("month"))
    return cf.compare_models(tested, 0.35, ["month"])


@query("smote_folds")
def smote_folds(spark, sf):
    """Out-of-fold scores where synthetic rows enter the training part only."""
    from pyspark.ml.functions import array_to_vector, vector_to_array

    def more_events(train):
        made = smote(
            train.withColumn("vec", vector_to_array("features")),
            "vec", "status", over=100, under=200, seed=fx.SEED,
        )
        return made.select(F.col("label").alias("status"), array_to_vector("vec").alias("features"))

    scores, _ = fr.cross_scores(
        _train(spark, sf), len(FEATURES), rebalance=more_events
    )
    return _rounded(scores)


_VECTOR = "CAST(embedding AS DOUBLE[])"
_SMOTE_STEPS = f"""
V AS (SELECT vec_id AS id, {_VECTOR} AS vec, label FROM embeddings),
NB AS (
  SELECT a.id, b.id AS near, row_number() OVER (PARTITION BY a.id ORDER BY list_distance(a.vec, b.vec), b.id) AS rn
  FROM V a JOIN V b ON a.id <> b.id WHERE a.label = 1 AND b.label = 1),
NL AS (SELECT id, list(near ORDER BY rn) AS near FROM NB WHERE rn <= 5 GROUP BY id),
SY AS (SELECT NL.id, copy, {seeded("'101'", "NL.id", "copy")} AS m, near
       FROM NL CROSS JOIN (SELECT unnest([1, 2]) AS copy)),
SX AS (SELECT id, copy, near[CAST({slot_of('m')} % len(near) AS INTEGER) + 1] AS neighbour,
              {slot_of('substr(m, 17, 8)')} / 4294967296 AS gap FROM SY),
MA AS (SELECT id, vec FROM V WHERE label = 0 ORDER BY {seeded("'101'", "id")}, id
       LIMIT (SELECT 2 * count(*) * 100 // 100 FROM V WHERE label = 1)),
ALLV AS (
  SELECT 'minority' AS kind, id, 0 AS copy, CAST(NULL AS BIGINT) AS neighbour, CAST(NULL AS DOUBLE) AS gap, vec, 1 AS label
  FROM V WHERE label = 1
  UNION ALL SELECT 'majority', id, 0, NULL, NULL, vec, 0 FROM MA
  UNION ALL SELECT 'synthetic', SX.id, copy, neighbour, gap,
    list_transform(list_zip(a.vec, b.vec), lambda z: z[1] + gap * (z[2] - z[1])), 1
  FROM SX JOIN V a ON a.id = SX.id JOIN V b ON b.id = neighbour)"""


@query(
    "smote",
    """SELECT kind, id, copy, neighbour, round(gap, 6) AS gap, label,
round(vec[1], 6) AS first_value, round(list_sum(vec), 4) AS total FROM ALLV""",
    _SMOTE_STEPS,
)
def smote_query(spark, sf):
    made = smote(
        fx.table(spark, sf, "embeddings"), "embedding", "label", "vec_id",
        over=200, under=100, seed=fx.SEED,
    )
    total = F.aggregate("vec", F.lit(0.0), lambda a, x: a + x)
    return made.select(
        "kind", "id", "copy", "neighbour", F.round("gap", 6).alias("gap"), "label",
        F.round(F.element_at("vec", 1), 6).alias("first_value"), F.round(total, 4).alias("total"),
    )
