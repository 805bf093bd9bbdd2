"""Probability forests with MLlib: fit, tune, score out of fold, pick, sweep.

The driver loops over fits only. Each fit is distributed, the fits of different folds run
side by side, all scores land in one long table, and every evaluation of that table is one
grouped query.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame, functions as F

from duskline.evaluation.confusion import best_fold
from duskline.models.grower import grown_forest
from duskline.operators.profiles import with_class_weight
from duskline.operators.sampling import assign_folds, downsample, fold_split
from duskline.sources.scratch import settle


# A fit's rows per task, of which every tree and level costs a pass.
ROWS_A_TASK = 5000


@dataclass(frozen=True)
class ForestParams:
    """200 trees, 50 columns tried per split, 63.2% of the rows per tree
    without replacement. A node of fewer than 100 rows was not split; MLlib bounds the
    children instead, hence 50. The depth is the largest MLlib has."""

    trees: int = 200
    columns: int = 50
    min_child_rows: int = 50
    depth: int = 30
    row_share: float = 0.632
    seed: int = 101
    # More split statistics per pass over the rows means fewer passes for wide rows.
    memory_mb: int = 1024

    def classifier(self, n_features: int, label: str, weight: str | None) -> RandomForestClassifier:
        forest = RandomForestClassifier(
            featuresCol="features",
            labelCol=label,
            numTrees=self.trees,
            featureSubsetStrategy=str(min(self.columns, n_features)),
            minInstancesPerNode=self.min_child_rows,
            maxDepth=self.depth,
            subsamplingRate=self.row_share,
            bootstrap=False,
            seed=self.seed,
            maxMemoryInMB=self.memory_mb,
            cacheNodeIds=True,
        )
        return forest.setWeightCol(weight) if weight else forest


def prepare(df: DataFrame, features: list[str], keep: list[str], name: str = "train") -> DataFrame:
    """One vector column beside the key columns, settled because every fold reads it."""
    vectors = VectorAssembler(inputCols=features, outputCol="features").transform(df)
    return settle(vectors.select(*keep, "features"), name)


def fit_forest(
    df: DataFrame,
    n_features: int,
    label: str = "status",
    params: ForestParams = ForestParams(),
    weight: str | None = None,
) -> PipelineModel:
    """MLlib's forest; trees that a task can grow whole are, with the same nodes: see ``grower``."""
    forest = params.classifier(n_features, label, weight)
    df = df.select("features", label, *([weight] if weight else []))
    n = df.count()
    rows = dealt_rows(df, n)

    def fit() -> PipelineModel:
        grown = None if weight else grown_forest(rows, forest, label, n_features, n)
        return grown or Pipeline(stages=[forest]).fit(rows)

    if rows is df:
        return fit()
    # A fit reads its rows several times before it keeps them itself.
    rows.persist()
    try:
        return fit()
    finally:
        rows.unpersist()


def dealt_rows(df: DataFrame, rows: int | None = None) -> DataFrame:
    """The rows of a fit in one partition per ``ROWS_A_TASK``, no more than the cluster has cores.

    A settled set of some ten thousand wide rows is one small file, which would be one task: all
    trees on one core. Each partition sends the statistics of every node once a level, so more
    partitions than cores would only shuffle more. Rows lie in an order of their own cells, so that
    the rows that MLlib draws do not follow from the order in which a shuffle brought them.
    """
    rows = df.count() if rows is None else rows
    tasks = min(df.sparkSession.sparkContext.defaultParallelism, math.ceil(rows / ROWS_A_TASK))
    if tasks <= 1:
        return df
    return df.repartition(tasks).sortWithinPartitions(F.xxhash64(*df.columns))


def fit_weighted(
    df: DataFrame, n_features: int, label: str = "status", params: ForestParams = ForestParams()
) -> PipelineModel:
    """Rows weighted by the share of the other class, and the smaller sample per tree that
    goes with it."""
    counts = {r[label]: r["n"] for r in df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    smaller = min(counts.values()) / sum(counts.values())
    weighted = with_class_weight(df, label)
    return fit_forest(
        weighted, n_features, label, replace(params, row_share=2 * smaller * 0.632), "weight"
    )


def score(model: PipelineModel, df: DataFrame, keep: list[str], name: str = "score") -> DataFrame:
    """Probability of the event."""
    p = F.get(vector_to_array("probability"), F.lit(1))  # a model of one class has no such place
    return model.transform(df).select(*keep, F.coalesce(p, F.lit(0.0)).alias(name))


def tune_forest(
    df: DataFrame,
    n_features: int,
    columns: list[int],
    child_rows: list[int],
    folds: int = 3,
    label: str = "status",
    key: list[str] = ("id",),
    params: ForestParams = ForestParams(),
    parallelism: int = 2,
) -> tuple[PipelineModel, list[dict]]:
    """Grid over columns per split and node size by log-loss; refit on the best."""
    forest = params.classifier(n_features, label, None)
    grid = (
        ParamGridBuilder()
        .addGrid(forest.featureSubsetStrategy, [str(min(c, n_features)) for c in columns])
        .addGrid(forest.minInstancesPerNode, child_rows)
        .build()
    )
    loss = MulticlassClassificationEvaluator(
        labelCol=label, probabilityCol="probability", metricName="logLoss"
    )
    search = CrossValidator(
        estimator=Pipeline(stages=[forest]),
        estimatorParamMaps=grid,
        evaluator=loss,
        numFolds=folds,
        foldCol="fold",
        parallelism=parallelism,
        seed=params.seed,
    )
    fitted = search.fit(assign_folds(df, folds, params.seed, list(key), label=label))
    results = [
        {
            "columns": int(p[forest.featureSubsetStrategy]),
            "child_rows": int(p[forest.minInstancesPerNode]),
            "log_loss": float(m),
        }
        for p, m in zip(grid, fitted.avgMetrics)
    ]
    return fitted.bestModel, results


def side_by_side(work, items: list, parallelism: int, df: DataFrame) -> list:
    """``work`` of every item, as many at a time as asked; the jobs share the executors."""
    pool = ThreadPool(max(1, min(parallelism, len(items))))
    try:
        return pool.map(inheritable_thread_target(df.sparkSession)(work), items, chunksize=1)
    finally:
        pool.close()


def cross_scores(
    df: DataFrame,
    n_features: int,
    k: int = 5,
    label: str = "status",
    key: list[str] = ("id",),
    params: ForestParams = ForestParams(),
    model_name: str = "forest",
    rebalance=None,
    parallelism: int = 4,
) -> tuple[DataFrame, list[PipelineModel]]:
    """Out-of-fold scores of k fits, stacked, and the models by fold.

    ``rebalance`` changes the training part only (class synthesis, downsampling), so no
    derived row can reach the fold it is validated on. As many as ``parallelism`` fits share
    the executors; the driver only waits for them.
    """
    smallest = df.groupBy(label).count().agg(F.min("count").alias("n"), F.count("*").alias("classes")).first()
    if smallest["classes"] < 2 or smallest["n"] < 2:
        raise ValueError(f"every training part needs two classes, the smallest class has {smallest['n']} rows")
    folded = settle(assign_folds(df, k, params.seed, list(key), label=label), "folded")

    def fit(fold: int) -> PipelineModel:
        train, _ = fold_split(folded, fold)
        return fit_forest(train if rebalance is None else rebalance(train), n_features, label, params)

    models = side_by_side(fit, list(range(k)), parallelism, df)
    keep = [*key, "fold", F.col(label).cast("int").alias("target")]
    scored = reduce(
        DataFrame.unionByName,
        [score(model, fold_split(folded, fold)[1], keep) for fold, model in enumerate(models)],
    )
    return scored.withColumn("model", F.lit(model_name)), models


def best_model(scores: DataFrame, models: list[PipelineModel]) -> tuple[int, PipelineModel]:
    """The fold model with the least squared error on its own held-out fold."""
    fold = best_fold(scores).head()["fold"]
    return fold, models[fold]


def sweep(
    sets: dict, test: DataFrame | dict[str, DataFrame], n_features: int, keep: list[str], k: int = 5,
    params: ForestParams = ForestParams(), label: str = "status", key: list[str] = ("id",),
    parallelism: int = 6,
) -> tuple[DataFrame, DataFrame, dict]:
    """Fit k folds per named training set, score the test rows (common ones, or each set's
    own) with each set's best model. Returns out-of-fold scores, test scores, and the models
    by name. The sets are worked on side by side, the folds of one set in turn."""

    def run(name: str) -> tuple[DataFrame, DataFrame, list[PipelineModel]]:
        scores, fitted = cross_scores(
            sets[name], n_features, k, label, key, params=params, model_name=str(name), parallelism=1
        )
        _, best = best_model(scores, fitted)
        rows = test[name] if isinstance(test, dict) else test
        part = score(best, rows, [*keep, F.col(label).cast("int").alias("target")])
        return scores, part.withColumn("model", F.lit(str(name))), fitted

    done = side_by_side(run, list(sets), parallelism, next(iter(sets.values())))
    oof, tested, models = zip(*done)
    return reduce(DataFrame.unionByName, oof), reduce(DataFrame.unionByName, tested), dict(zip(sets, models))


def month_sweep(
    rows: DataFrame, n_features: int, ratio: int = 10, k: int = 5,
    params: ForestParams = ForestParams(), label: str = "status", key: list[str] = ("id", "event"),
) -> tuple[DataFrame, DataFrame, dict]:
    """The months against the year: one model per calendar month and one of all months.

    ``rows`` has ``month``, ``split`` (train or test), the key, the label and ``features``. The
    controls of each month's training rows are cut to ``ratio`` per event; the year model
    learns from all of these together. A month's model scores that month of the test split, the
    year model every month. A month whose training rows have fewer than two of a class gets no
    model and has the year's scores only. Results as from ``sweep``, models named by the month
    number and ``year``.
    """
    train, test = rows.filter("split = 'train'"), rows.filter("split = 'test'")
    even = settle(downsample(train, label, ratio, params.seed, list(key), ["month"]), "month_train")
    classes = even.groupBy("month", label).count().filter(F.col("count") >= 2)  # 24 rows at most
    months = sorted(r["month"] for r in classes.groupBy("month").count().filter("count = 2").collect())
    sets = {str(m): even.filter(F.col("month") == m) for m in months} | {"year": even}
    tests = {str(m): test.filter(F.col("month") == m) for m in months} | {"year": test}
    return sweep(sets, tests, n_features, [*key, "month"], k, params, label, key)
