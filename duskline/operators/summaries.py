"""Co-moments and quantiles of many columns in passes that merge, exact whatever the number of rows."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from duskline.sources.scratch import settle

#: Partial results that one task merges; columns whose sketches a pass holds.
MERGED, SKETCHED = 32, 32
#: Cut points of a pass, and the accuracy of the sketch that gives them: ten times finer.
CUTS, ACCURACY = 1000, 10_000
#: Rows that a bracket may hold when its values are counted one by one.
FEW = 100_000

_MOMENTS = "n bigint, gaps array<bigint>, mean array<double>, cross array<double>"
_KIND = pa.schema(
    [("n", pa.int64()), ("gaps", pa.list_(pa.int64())), ("mean", pa.list_(pa.float64())), ("cross", pa.list_(pa.float64()))]
)


def _merged(a, b):
    """Moments of two sets of rows as those of both: counts, means and centred products."""
    if a is None or a[0] == 0:
        return b if a is None else (b[0], a[1] + b[1], b[2], b[3])
    if b[0] == 0:
        return a[0], a[1] + b[1], a[2], a[3]
    n = a[0] + b[0]
    apart = b[2] - a[2]
    return n, a[1] + b[1], a[2] + apart * (b[0] / n), a[3] + b[3] + np.outer(apart, apart) * (a[0] * b[0] / n)


def _row(moments) -> pa.RecordBatch:
    n, gaps, mean, cross = moments
    return pa.RecordBatch.from_arrays(
        [pa.array([n]), pa.array([gaps.tolist()], _KIND.types[1]), pa.array([mean], _KIND.types[2]), pa.array([cross.ravel()], _KIND.types[3])],
        schema=_KIND,
    )


def _moments_of(batches):
    """One row per task: the moments of all its rows. A null counts as a gap and as zero."""
    state = None
    for batch in batches:
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        x = np.column_stack(columns).astype(float)
        gaps = np.isnan(x).sum(axis=0)
        x = np.nan_to_num(x, nan=0.0, posinf=np.inf, neginf=-np.inf)
        mean = x.mean(axis=0) if len(x) else np.zeros(x.shape[1])
        state = _merged(state, (len(x), gaps, mean, (x - mean).T @ (x - mean)))
    if state is not None:
        yield _row(state)


def _merge_rows(batches):
    state = None
    for batch in batches:
        for row in batch.to_pylist():
            d = len(row["mean"])
            cross = np.array(row["cross"], dtype=float).reshape(d, d)
            state = _merged(state, (row["n"], np.array(row["gaps"]), np.array(row["mean"], dtype=float), cross))
    if state is not None:
        yield _row(state)


def co_moments(df: DataFrame, cols: list[str]):
    """(n, gaps, mean, cross) of ``cols`` as numpy arrays, in one scan; None for no rows.

    Every task sends its moments, columns squared numbers; some tasks merge ``MERGED`` of them each,
    one merges what is left. NaN counts as null.
    """
    part = df.select(*[F.col(f"`{c}`").cast("double") for c in cols]).mapInArrow(_moments_of, _MOMENTS)
    part = settle(part, "moments")
    while (n := part.count()) > 1:
        few = math.ceil(n / MERGED)
        dealt = part.repartition(few) if few > 1 else part.coalesce(1)
        part = settle(dealt.mapInArrow(_merge_rows, _MOMENTS), "moments")
    row = part.mapInArrow(_merge_rows, _MOMENTS).first()
    if row is None:
        return None
    d = len(cols)
    return row["n"], np.array(row["gaps"]), np.array(row["mean"]), np.array(row["cross"]).reshape(d, d)


def pearson(df: DataFrame, cols: list[str]) -> list[tuple[str, str, float | None]]:
    """(a, b, r) of every pair; None where a column has a null or no spread."""
    found = co_moments(df, cols)
    if found is None:
        return [(a, b, None) for a in cols for b in cols]
    _, gaps, _, cross = found
    spread = np.sqrt(np.diag(cross))
    good = (gaps == 0) & (spread > 0) & np.isfinite(spread)
    return [
        (a, b, float(np.clip(cross[i, j] / (spread[i] * spread[j]), -1, 1)) if good[i] and good[j] else None)
        for i, a in enumerate(cols)
        for j, b in enumerate(cols)
    ]


def _wanted(n: int, p: float) -> tuple[int, int, float]:
    """The two ranks, from 0, between which the quantile lies, and how far."""
    at = (n - 1) * p
    low = math.floor(at)
    return low, math.ceil(at), at - low


def _inside(c: str, bracket: tuple) -> Column:
    value, (low, high) = F.col(f"`{c}`").cast("double"), bracket
    value = F.when(~F.isnan(value), value)
    if low is not None:
        value = F.when(value >= low, value)
    return value if high is None else F.when(value <= high, value)


def _below(c: str, bracket: tuple) -> Column:
    return F.count_if(F.col(f"`{c}`").cast("double") < bracket[0]) if bracket[0] is not None else F.lit(0).cast("long")


def _brackets(df: DataFrame, cols: list[str], shares: list[float]) -> dict:
    """For each (column, share): count of values, values below a bracket and the bracket, which holds both ranks."""
    points = [i / CUTS for i in range(CUTS + 1)]
    done, open_ones = {}, {(c, p): (None, None) for c in cols for p in shares}
    while open_ones:
        spans = sorted({(c, b) for (c, _), b in open_ones.items()}, key=str)
        parts = []
        for c, b in spans:
            v = _inside(c, b)
            parts += [F.struct(_below(c, b).alias("below"), F.count(v).alias("n"), F.percentile_approx(v, F.lit(points), ACCURACY).alias("cuts"))]
        found = dict(zip(spans, df.agg(*[x.alias(f"_{i}") for i, x in enumerate(parts)]).first()))
        again = {}
        for (c, p), b in open_ones.items():
            below, n, cuts = found[c, b]
            total = done.get((c, p), (n,))[0]
            done[c, p] = (total, below, b)
            if n <= FEW or cuts[0] == cuts[-1]:
                continue
            low, high, _ = _wanted(total, p)
            at = (low - below) / n * CUTS
            new = cuts[max(0, math.floor(at) - 1)], cuts[min(CUTS, math.ceil((high - below) / n * CUTS) + 1)]
            if new != b:
                again[c, p] = new
        open_ones = again
    return done


def quantiles(df: DataFrame, cols: list[str], shares: list[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """(column, share, value): exact quantiles, interpolated between the two ranks around (n - 1) * share.

    Null and NaN do not count; a column without values has null. A pass over the rows keeps a mergeable
    sketch per bracket, whose cut points narrow the bracket around a quantile some hundredfold;
    when a bracket holds ``FEW`` rows or one value, its values are counted and the ranks are looked up.
    The driver holds a bracket per quantile. ``SKETCHED`` columns share a pass, so that the
    sketches fit into a task, and only these are read.
    """
    spark, parts = df.sparkSession, []
    for at in range(0, len(cols), SKETCHED):
        block = list(cols[at : at + SKETCHED])
        rows = df.select(*[F.col(f"`{c}`") for c in block])
        found = _brackets(rows, block, list(shares))
        hits = F.array(
            *[
                F.struct(F.lit(c).alias("column"), F.lit(p).alias("share"), _inside(c, b).alias("v"))
                for (c, p), (_, _, b) in found.items()
            ]
        )
        counted = rows.select(F.inline(hits)).filter("v IS NOT NULL").groupBy("column", "share", "v").agg(F.count("*").alias("n"))
        asked = []
        for (c, p), (n, below, _) in found.items():
            low, high, gap = _wanted(n, p) if n else (0, 0, 0.0)
            asked.append((c, p, low - below, high - below, gap))
        asked = spark.createDataFrame(asked, "column string, share double, low long, high long, gap double")
        upto = F.sum("n").over(Window.partitionBy("column", "share").orderBy("v"))
        ranked = counted.withColumn("upto", upto).join(F.broadcast(asked), ["column", "share"])
        first = lambda rank: F.min(F.when(F.col("upto") > F.col(rank), F.col("v")))
        ends = ranked.groupBy("column", "share").agg(first("low").alias("a"), first("high").alias("b"), F.max("gap").alias("gap"))
        ends = ends.select("column", "share", (F.col("a") + (F.col("b") - F.col("a")) * F.col("gap")).alias("value"))
        parts.append(asked.select("column", "share").join(ends, ["column", "share"], "left"))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def text_levels(df: DataFrame, cols: list[str], top: int = 6) -> DataFrame:
    """(column, level, rows, rank): the most frequent values of text columns, null among them; ties by value."""
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("level")) for c in cols])
    counts = df.select(F.inline(pairs)).groupBy("column", "level").agg(F.count("*").alias("rows"))
    order = Window.partitionBy("column").orderBy(F.desc("rows"), F.col("level").asc_nulls_first())
    return counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
