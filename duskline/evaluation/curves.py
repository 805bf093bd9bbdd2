"""Threshold choice on a grid, and exact curves.

A threshold is chosen among 101 grid points, so its histogram is small. Curves, areas and
equal error rates are those of the scores themselves: equal scores are one point, and running
counts are summed in ranges of scores, so no window holds a whole model.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from duskline.functions.numbers import share
from duskline.operators.joins import null_safe
from duskline.sources.scratch import settle

GRID = 100


def grid_cell(score: Column, steps: int) -> Column:
    """Largest k in 0..steps with ``score >= k / steps``, exact at the grid points."""
    k = F.floor(score * steps)
    k = k + F.when(score >= (k + 1) / F.lit(float(steps)), 1).otherwise(0)
    k = k - F.when(score < k / F.lit(float(steps)), 1).otherwise(0)
    return F.least(k, F.lit(steps)).cast("int")


def histogram(scores: DataFrame, steps: int, by: list[str]) -> DataFrame:
    return (
        scores.withColumn("cell", grid_cell(F.col("score"), steps))
        .groupBy(*by, "cell")
        .agg(
            F.count_if(F.col("target") == 1).alias("p"),
            F.count_if(F.col("target") == 0).alias("n"),
        )
    )


def _cumulative(scores: DataFrame, by: list[str]) -> DataFrame:
    """Per distinct score: its counts, the counts at or above it, and class totals.

    Distinct scores are dealt to ranges and written. The totals of the ranges, one row per range
    and model, give each range the counts above it; the rest is a window inside the range.
    """
    points = scores.groupBy(*by, "score").agg(
        F.count_if(F.col("target") == 1).alias("p"), F.count_if(F.col("target") == 0).alias("n")
    )
    ranged = points.repartitionByRange(*by, "score").withColumn("_range", F.spark_partition_id())
    ranged = settle(ranged, "score_ranges")
    above = Window.partitionBy(*by).orderBy(F.col("_range").desc()).rowsBetween(Window.unboundedPreceding, -1)
    model = Window.partitionBy(*by)
    sums = ranged.groupBy(*by, "_range").agg(F.sum("p").alias("_p"), F.sum("n").alias("_n"))
    sums = sums.select(
        *by,
        "_range",
        F.coalesce(F.sum("_p").over(above), F.lit(0)).alias("_tp"),
        F.coalesce(F.sum("_n").over(above), F.lit(0)).alias("_fp"),
        F.sum("_p").over(model).alias("pos"),
        F.sum("_n").over(model).alias("neg"),
    )
    on = [*by, "_range"]
    inside = Window.partitionBy(*[F.col(f"_l.{c}") for c in on]).orderBy(F.col("score").desc())
    return (
        ranged.alias("_l")
        .join(sums.alias("_r"), null_safe(on, "_l", "_r"))
        .select(
            *[F.col(f"_l.{c}") for c in by],
            "score",
            "p",
            "n",
            (F.sum("p").over(inside) + F.col("_tp")).alias("tp"),
            (F.sum("n").over(inside) + F.col("_fp")).alias("fp"),
            "pos",
            "neg",
        )
    )


def grid_counts(scores: DataFrame, by: list[str] = ("model",)) -> DataFrame:
    """Confusion counts at every threshold 0.00, 0.01, .. 1.00."""
    by = list(by)
    # At most 101 cells per group, so the list is small however many scores there are.
    cells = histogram(scores, GRID, by).groupBy(*by).agg(
        F.collect_list(F.struct("cell", "p", "n")).alias("_h"),
        F.sum("p").alias("pos"),
        F.sum("n").alias("neg"),
    )
    points = cells.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(GRID))))

    def at_or_above(part: str) -> Column:
        return F.aggregate(
            "_h",
            F.lit(0).cast("long"),
            lambda acc, x: acc + F.when(x["cell"] >= F.col("_k"), x[part]).otherwise(0),
        )

    tp, fp = at_or_above("p"), at_or_above("n")
    return points.select(
        *by,
        (F.col("_k") / F.lit(float(GRID))).alias("threshold"),
        tp.alias("tp"),
        fp.alias("fp"),
        (F.col("pos") - tp).alias("fn"),
        (F.col("neg") - fp).alias("tn"),
    )


def _criterion(method: str) -> Column:
    tp, fp, fn, tn = (F.col(c).cast("double") for c in ["tp", "fp", "fn", "tn"])
    n = tp + fp + fn + tn
    if method == "youden":
        return share(tp, tp + fn) + share(tn, tn + fp)
    if method == "kappa":
        po = share(tp + tn, n)
        pe = share((tp + fp) * (tp + fn) + (fn + tn) * (fp + tn), n * n)
        return share(po - pe, 1 - pe)
    if method == "f1":
        return F.when(tp + fp > 0, share(2 * tp, 2 * tp + fp + fn))
    raise ValueError(method)


def best_threshold(scores: DataFrame, method: str, by: list[str] = ("model",)) -> DataFrame:
    """Grid threshold with the best criterion per model; the lowest wins a tie."""
    value = F.round(_criterion(method), 9)
    best = F.max(F.struct(F.col("value"), (-F.col("threshold")).alias("t")))
    return (
        grid_counts(scores, by)
        .select(*by, "threshold", value.alias("value"))
        .filter(F.col("value").isNotNull())
        .groupBy(*by)
        .agg(best.alias("_b"))
        .select(*by, F.round(-F.col("_b.t"), 2).alias("threshold"), F.round("_b.value", 6).alias("value"))
    )


def mean_threshold(best: DataFrame) -> DataFrame:
    """One threshold shared by all models: the mean of theirs."""
    return best.agg(F.round(F.avg("threshold"), 4).alias("threshold"), F.count(F.lit(1)).alias("models"))


def roc_curve(scores: DataFrame, by: list[str] = ("model",)) -> DataFrame:
    """Points (fpr, tpr) at every distinct score."""
    c = _cumulative(scores, list(by))
    return c.select(
        *by,
        "score",
        F.round(share(F.col("fp"), F.col("neg")), 6).alias("fpr"),
        F.round(share(F.col("tp"), F.col("pos")), 6).alias("tpr"),
    )


def auc(scores: DataFrame, by: list[str] = ("model",)) -> DataFrame:
    """Area under the ROC points by trapezoids; equal scores count half."""
    c = _cumulative(scores, list(by))
    wins = F.sum(F.col("n") * (F.col("tp") - F.col("p") / 2.0))
    return c.groupBy(*by).agg(
        F.round(share(wins, F.max(F.col("pos").cast("double") * F.col("neg"))), 6).alias("auc")
    )


def det_curve(scores: DataFrame, by: list[str] = ("model",)) -> DataFrame:
    """Points (fpr, fnr) at every distinct score."""
    c = _cumulative(scores, list(by))
    return c.select(
        *by,
        "score",
        F.round(share(F.col("fp"), F.col("neg")), 6).alias("fpr"),
        F.round(share(F.col("pos") - F.col("tp"), F.col("pos")), 6).alias("fnr"),
    )


def eer(scores: DataFrame, by: list[str] = ("model",)) -> DataFrame:
    """Error rate where fpr and fnr are closest; the highest threshold wins a tie."""
    gap = F.round(F.abs(F.col("fpr") - F.col("fnr")), 6)
    least = F.min(F.struct(gap.alias("gap"), (-F.col("score")).alias("c"), "fpr", "fnr"))
    return (
        det_curve(scores, by)
        .groupBy(*by)
        .agg(least.alias("_m"))
        .select(
            *by,
            (-F.col("_m.c")).alias("threshold"),
            F.round((F.col("_m.fpr") + F.col("_m.fnr")) / 2, 6).alias("eer"),
        )
    )


def pr_curve(scores: DataFrame, by: list[str] = ("model",)) -> DataFrame:
    """Points (recall, precision) at every distinct score."""
    c = _cumulative(scores, list(by))
    return c.select(
        *by,
        "score",
        F.round(share(F.col("tp"), F.col("pos")), 6).alias("recall"),
        F.round(share(F.col("tp"), F.col("tp") + F.col("fp")), 6).alias("precision"),
    )
