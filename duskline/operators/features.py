"""Leakage-safe wide rows: monthly lags before an anchor and the annual block known then.

A panel has one row per entity and month (see ``timeline.dedupe``), so the rows that meet
one anchor are bounded by the window length however uneven the raw data was.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from duskline.functions.dates import anchor_month, known_year, lag_months
from duskline.functions.numbers import filled_cells, quoted
from duskline.operators.joins import grown, null_safe

LAGS = 12
GAP = 3
#: Anchors that one task joins with their rows and groups.
ANCHORS_A_TASK = 200_000


def _zero_if_null(value: str, name: str) -> str:
    return f"coalesce(CAST({quoted(value)} AS DOUBLE), 0D) AS {quoted(name)}"


def _zero_if_null_of(struct: str, field: str, name: str) -> str:
    return f"coalesce(CAST({struct}.{quoted(field)} AS DOUBLE), 0D) AS {quoted(name)}"


def lag_names(metrics: list[str], n: int = LAGS) -> list[str]:
    return [f"{m}_M_{i}" for m in metrics for i in range(1, n + 1)]


def annual_names(cols: list[str]) -> list[str]:
    return [f"{c}_Y_1" for c in cols]


def _window_rows(anchors: DataFrame, panel: DataFrame, metrics: list[str], n: int, gap: int):
    """Panel rows inside the window of an anchor, and one empty row per anchor.

    An inner join lets either side be broadcast: with few anchors the panel is filtered
    where it lies and only the window rows move. The empty rows keep anchors that meet
    nothing, which an outer join would do only by shuffling the whole panel.

    The months no anchor can reach are cut at the scan: a set for one test month reads
    one year of the panel, by folder where it is stored in year folders.

    More anchors than ``ANCHORS_A_TASK`` and the panel are dealt by entity, a partition per so many
    anchors, and meet in an outer join: grouping what is found moves nothing any more, and what a
    task sorts and groups does not grow with the anchors.
    """
    keys = anchors.columns
    parts = math.ceil(anchors.count() / ANCHORS_A_TASK)
    span = anchors.agg(F.struct(F.min("event").alias("a"), F.max("event").alias("b"))).scalar()
    first, last = F.add_months(span["a"], 1 - gap - n), F.add_months(span["b"], -gap)
    reached = panel.filter(F.col("period").between(first, last))
    if "year" in panel.columns:
        reached = reached.filter(F.col("year").between(F.year(first), F.year(last)))
    p = reached.select(F.col("id").alias("_id"), F.col("period").alias("_period"), *metrics)
    in_window = (
        (F.col("id") == F.col("_id"))
        & (F.col("_period") <= anchor_month("event", gap))
        & (F.col("_period") > anchor_month("event", gap + n))
    )
    lag = lag_months("event", "_period", gap).alias("_lag")
    if parts > 1:
        met = anchors.repartition(parts, "id").join(grown(p.repartition(parts, "_id")), in_window, "left")
        return met.select(*keys, lag, *metrics)
    found = anchors.join(p, in_window).select(*keys, lag, *metrics)
    types = {f.name: f.dataType.simpleString() for f in p.schema.fields}
    empty = [f"CAST(NULL AS {types[m]}) AS {quoted(m)}" for m in metrics]
    return found.unionByName(
        anchors.selectExpr(*map(quoted, keys), "CAST(NULL AS INT) AS _lag", *empty)
    )


def lag_features(
    anchors: DataFrame, panel: DataFrame, metrics: list[str], n: int = LAGS, gap: int = GAP
) -> DataFrame:
    """``<metric>_M_<i>`` for i = 1..n, counted back in calendar months from the anchor.

    ``anchors`` has ``id``, ``event`` and any other key columns, and is read four times:
    settle it if it is costly. Missing months are 0 and shift nothing.
    """
    keys = anchors.columns
    wide = (
        _window_rows(anchors, panel, metrics, n, gap)
        .groupBy(*keys)
        .pivot("_lag", list(range(1, n + 1)))
        .agg(*[F.first(m, ignorenulls=True).alias(m) for m in metrics])
    )
    cells = [
        _zero_if_null(f"{i}_{m}" if len(metrics) > 1 else f"{i}", f"{m}_M_{i}")
        for m in metrics
        for i in range(1, n + 1)
    ]
    return wide.selectExpr(*map(quoted, keys), *cells)


def filled_lag_cells(
    anchors: DataFrame, panel: DataFrame, metrics: list[str], n: int = LAGS, gap: int = GAP
) -> DataFrame:
    """Number of non-zero lag cells per anchor, without building the wide row."""
    rows = _window_rows(anchors, panel, metrics, n, gap)
    return rows.groupBy(*anchors.columns).agg(F.sum(filled_cells(metrics)).cast("int").alias("filled"))


def lag_features_dense(
    panel: DataFrame,
    metrics: list[str],
    n: int = LAGS,
    gap: int = GAP,
    years: list[int] | None = None,
    without: DataFrame | None = None,
) -> DataFrame:
    """The same row for every entity and every calendar month as pseudo-event.

    The calendar is made complete first; after that a lag in rows is a lag in months, and
    one sort by entity serves all cells. Months before the panel count as 0.

    With ``years`` only months of those years in which the entity has a row are given, and the
    calendar goes no further back than their lags reach. ``without`` (id, month) leaves an entity
    out in a calendar month of every year. Both are facts of the entity, few per row, that
    travel with the calendar, so the wide rows are neither joined nor moved for them.
    """
    span = panel.agg(F.struct(F.min("period").alias("a"), F.max("period").alias("b"))).scalar()
    first, last = span["a"], span["b"]
    if years is not None:
        reach = F.make_date(F.lit(min(years)), F.lit(1), F.lit(1))
        first = F.greatest(first, F.add_months(reach, 1 - n - gap))
        last = F.least(last, F.make_date(F.lit(max(years)), F.lit(12), F.lit(1)))
    months = F.when(first <= last, F.sequence(first, last, F.expr("interval 1 month")))
    ids = panel.groupBy("id").agg(F.collect_set(F.year("period")).alias("_years"))
    asked = F.lit(True)
    if years is not None:
        asked = F.year("period").isin(years) & F.array_contains("_years", F.year("period"))
    if without is not None:
        off = without.groupBy("id").agg(F.collect_set("month").alias("_off"))
        ids = ids.join(off, "id", "left")
        asked = asked & ~F.coalesce(F.array_contains("_off", F.month("period")), F.lit(False))
    calendar = ids.select("*", F.explode(months).alias("period")).select("id", "period", asked.alias("_asked"))
    dense = calendar.join(panel.select("id", "period", *metrics), ["id", "period"], "left")
    cells = [
        f"coalesce(CAST(lag({quoted(m)}, {i + gap - 1}) OVER (PARTITION BY id ORDER BY period)"
        f" AS DOUBLE), 0D) AS {quoted(f'{m}_M_{i}')}"
        for m in metrics
        for i in range(1, n + 1)
    ]
    return dense.selectExpr("id", "period AS event", "_asked", *cells).filter("_asked").drop("_asked")


def annual_features(
    anchors: DataFrame, annual: DataFrame, cols: list[str], cutoff: int = 7
) -> DataFrame:
    """``<col>_Y_1`` from the latest annual row known at the event; no row gives 0.

    ``annual`` has one row per ``id`` and ``year``. ``anchors`` is read three times: settle it if
    it is costly. Of more anchors than ``ANCHORS_A_TASK`` neither the keys nor the rows found are broadcast.
    """
    many = anchors.count() > ANCHORS_A_TASK
    asked = anchors.withColumn("_known", known_year("event", cutoff))
    on = ["id", "_known"]
    # Only the asked rows of the annual table move to the anchors.
    keys = asked.select(*on).distinct()
    known = annual.select("id", F.col("year").alias("_known"), *cols).join(grown(keys) if many else keys, on, "left_semi")
    joined = asked.join(grown(known) if many else known, on, "left")
    cells = [_zero_if_null(c, f"{c}_Y_1") for c in cols]
    return joined.selectExpr(*map(quoted, anchors.columns), *cells)


def annual_features_dense(
    rows: DataFrame, annual: DataFrame, cols: list[str], cutoff: int = 7
) -> DataFrame:
    """The annual block for rows that lie together by entity, as the dense lags do.

    The few years of an entity travel as one map, so the join is on the entity alone and
    the wide rows stay where they are. ``annual`` has one row per ``id`` and ``year``.
    """
    years = annual.groupBy("id").agg(
        F.map_from_entries(F.collect_list(F.struct("year", F.struct(*cols)))).alias("_years")
    )
    known = rows.join(years, "id", "left").withColumn(
        "_known", F.try_element_at("_years", known_year("event", cutoff))
    )
    cells = [_zero_if_null_of("_known", c, f"{c}_Y_1") for c in cols]
    return known.selectExpr(*map(quoted, rows.columns), *cells)


def feature_rows(
    anchors: DataFrame,
    panel: DataFrame,
    metrics: list[str],
    annual: DataFrame,
    annual_cols: list[str],
    status: int | None = None,
    n: int = LAGS,
    gap: int = GAP,
    cutoff: int = 7,
) -> DataFrame:
    """Lags and annual block of each anchor, with the class label if one is given.

    ``anchors`` is unique and should be settled: the lags, the annual block and their
    join each start from it.
    """
    lags = lag_features(anchors, panel, metrics, n, gap)
    block = annual_features(anchors, annual, annual_cols, cutoff)
    # An anchor whose further key columns are null must meet itself.
    keys = anchors.columns
    wide = lags.alias("_l").join(block.alias("_r"), null_safe(keys, "_l", "_r")).select(
        "_l.*", *[F.col(f"_r.{quoted(c)}") for c in annual_names(annual_cols)]
    )
    if status is not None:
        wide = wide.withColumn("status", F.lit(status))
    return wide
