"""Counts, shares and correlations that describe a panel or a set."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import Correlation
from pyspark.sql import Column, DataFrame, functions as F

from duskline.functions.numbers import share
from duskline.operators.summaries import pearson
from duskline.sources.scratch import settle


def category_pairs(df: DataFrame, c: str, event: Column, id: str = "id") -> DataFrame:
    """Distinct (entity, category, status): event pairs come from event rows only, and
    an event entity gives no healthy pair."""
    bad = df.filter(event).select(id, c).distinct().withColumn("status", F.lit(1))
    good = df.select(id, c).distinct().join(bad.select(id), id, "left_anti")
    return good.withColumn("status", F.lit(0)).unionByName(bad)


def category_risk(df: DataFrame, c: str, event: Column, id: str = "id") -> DataFrame:
    """Healthy and event entities per category value and the event share; null is a value."""
    pairs = category_pairs(df, c, event, id)
    bad, good = F.count_if(F.col("status") == 1), F.count_if(F.col("status") == 0)
    return pairs.groupBy(F.col(c).alias("category")).agg(
        good.alias("healthy"),
        bad.alias("events"),
        F.round(share(bad, good + bad), 4).alias("ratio"),
    )


def risk_rank(risk: DataFrame, parts: int = 50) -> DataFrame:
    """Rank 1 + ratio %/% step with step = range / parts; no range gives no rank.

    The table has a row per category, but computing it reads the panel: it is settled
    because both the range and the ranks need it.
    """
    risk = settle(risk, "risk")
    step = risk.agg(((F.max("ratio") - F.min("ratio")) / parts).alias("s")).scalar()
    rank = F.floor(F.try_divide(F.col("ratio"), step)) + 1
    return risk.withColumn("rank", rank.cast("int"))


def class_calendar(
    df: DataFrame,
    years: list[int],
    event: str = "event",
    status: str = "status",
    classes: list[int] = (0, 1),
) -> DataFrame:
    """Rows per class, calendar month and year, one column per year: all twelve months of every
    class, zeros filled. ``other_years`` counts the rows of years that are not listed."""
    year = F.year(event)
    counts = df.groupBy(F.col(status).alias("_class"), F.month(event).alias("_month")).agg(
        *[F.count_if(year == y).alias(f"y{y}") for y in years],
        F.count_if(~year.isin(years)).alias("other_years"),
    )
    months = df.sparkSession.range(1, 13).select(
        F.explode(F.array(*[F.lit(c) for c in classes])).alias(status), F.col("id").cast("int").alias("month")
    )
    cond = (F.col(status) == F.col("_class")) & (F.col("month") == F.col("_month"))
    cells = [F.coalesce(c, F.lit(0)).alias(c) for c in [*[f"y{y}" for y in years], "other_years"]]
    return months.join(counts, cond, "left").select(status, "month", *cells)


def mean_by(df: DataFrame, c: str, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(c).alias(f"mean_{c}"), F.count(c).alias("n"))


def corr_matrix(df: DataFrame, cols: list[str], digits: int = 2, method: str = "pearson") -> DataFrame:
    """Correlation of every pair of columns as (a, b, r), ``pearson`` or ``spearman``.

    ``pearson`` is one scan, whose tasks send co-moments that are merged; ``spearman`` ranks every column
    first, which sorts it. The driver gets one number per pair. A column with a null or without
    spread has no correlation: null.
    """
    spark = df.sparkSession
    if method == "pearson":
        rows = pearson(df, list(cols))
    else:
        df = settle(df.select(*cols), "numbers")
        numbers = df.select(*[F.coalesce(F.col(c).cast("double"), F.lit(float("nan"))).alias(c) for c in cols])
        vectors = VectorAssembler(inputCols=list(cols), outputCol="v", handleInvalid="keep").transform(numbers)
        r = Correlation.corr(vectors.select("v"), "v", method).first()[0].toArray()
        gaps = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols]).first()
        rows = [
            (a, b, None if gaps[a] or gaps[b] else float(r[i, j])) for i, a in enumerate(cols) for j, b in enumerate(cols)
        ]
    value = F.when(~F.isnan("r"), F.round("r", digits)).alias("r")
    return spark.createDataFrame(rows, "a string, b string, r double").select("a", "b", value)


def summarize(df: DataFrame, cols: list[str]) -> DataFrame:
    """Count, nulls, mean, spread and bounds per column, in one pass."""
    parts = []
    for c in cols:
        v = F.col(c).cast("double")
        parts.append(
            F.struct(
                F.lit(c).alias("column"),
                F.count(v).alias("n"),
                F.count_if(v.isNull()).alias("nulls"),
                F.avg(v).alias("mean"),
                F.stddev_samp(v).alias("sd"),
                F.min(v).alias("low"),
                F.max(v).alias("high"),
            )
        )
    return df.agg(F.array(*parts).alias("_s")).select(F.inline("_s"))


def class_balance(
    df: DataFrame,
    status: str = "status",
    by: list[str | Column] = (),
    extra: list[Column] = (),
) -> DataFrame:
    """Rows per class, event share and healthy rows per event row; ``extra`` aggregates
    ride along in the same pass."""
    bad, good = F.count_if(F.col(status) == 1), F.count_if(F.col(status) == 0)
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"),
        good.alias("healthy"),
        bad.alias("events"),
        F.round(share(bad, good + bad), 6).alias("share"),
        F.round(share(good, bad), 4).alias("ratio"),
        *extra,
    )


def row_audit(before: DataFrame, after: DataFrame, by: list[str], periods: int = 12) -> DataFrame:
    """Rows at the start, removed and left, the percentage removed and the entities that
    many rows stand for."""
    a = before.groupBy(*by).agg(F.count(F.lit(1)).alias("start_rows"))
    b = after.groupBy(*by).agg(F.count(F.lit(1)).alias("rows_left"))
    left = F.coalesce(F.col("rows_left"), F.lit(0))
    return a.join(b, list(by), "left").select(
        *by,
        "start_rows",
        left.alias("rows_left"),
        (F.col("start_rows") - left).alias("removed"),
        F.round((F.col("start_rows") - left) / F.col("start_rows") * 100, 2).alias("removed_pct"),
        F.round(left / F.lit(periods), 4).alias("entities_left"),
    )


def class_weights(df: DataFrame, status: str = "status") -> DataFrame:
    """Per class: rows, share, the weight of its rows (the other class's share) and the
    sample fraction 2 * smaller share * 0.632."""
    n = F.count(F.lit(1))
    bad = F.count_if(F.col(status) == 1)
    shares = df.agg(n.alias("n"), bad.alias("n1")).select(
        "n", "n1", share(F.col("n1"), F.col("n")).alias("p1"),
        share(F.col("n") - F.col("n1"), F.col("n")).alias("p0"),
    )
    fraction = F.round(F.least("p0", "p1") * 2 * 0.632, 6).alias("sample_fraction")
    rows = F.array(
        F.struct(F.lit(0).alias("status"), (F.col("n") - F.col("n1")).alias("rows"),
                 F.round("p0", 6).alias("share"), F.round("p1", 6).alias("weight"), fraction),
        F.struct(F.lit(1).alias("status"), F.col("n1").alias("rows"),
                 F.round("p1", 6).alias("share"), F.round("p0", 6).alias("weight"), fraction),
    )
    return shares.select(F.inline(rows))


def with_class_weight(df: DataFrame, status: str = "status", name: str = "weight") -> DataFrame:
    """Each row weighted by the share of the other class."""
    p1 = df.agg(F.avg(F.col(status).cast("double")).alias("p")).scalar()
    return df.withColumn(name, F.when(F.col(status) == 1, 1 - p1).otherwise(p1))
