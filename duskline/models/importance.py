"""Variable importances of fitted forests, joined by name."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, functions as F


def importances(
    spark: SparkSession, model: PipelineModel, features: list[str], run: str
) -> DataFrame:
    """One row per variable; the values of a model sum to 1."""
    values = model.stages[-1].featureImportances.toArray()
    rows = [(run, name, float(v)) for name, v in zip(features, values)]
    return spark.createDataFrame(rows, "run string, variable string, importance double")


def importance_matrix(long: DataFrame, runs: list[str]) -> DataFrame:
    """Variables down, runs across; a variable a run lacks is null there."""
    return long.groupBy("variable").pivot("run", runs).agg(F.first("importance"))
