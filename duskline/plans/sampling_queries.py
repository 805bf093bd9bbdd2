"""Anchors, matched controls, samples, folds, training and test sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from duskline.operators import (
    datasets as ds,
    exchange as xc,
    exclusion as ex,
    features as ft,
    profiles as pr,
    projection as pj,
    sampling as sp,
    summaries as sm,
)
from duskline.plans import fixtures as fx
from duskline.plans.catalog import query
from duskline.plans.oracle_views import seeded, slot_of
from duskline.plans.timeline_queries import annual_sql, lag_sql
from duskline.sources.scratch import settle

SEED = fx.SEED
RATIOS = [1, 2, 4, 6, 8, 10, 12, 14, 16, 18, 20, 25, 30]


@query(
    "anchors_fixed",
    """SELECT c_custkey AS id, make_date(y, m, 1) AS event FROM customer
CROSS JOIN (SELECT unnest([1999, 2000]) AS y) CROSS JOIN (SELECT unnest([1, 7]) AS m)""",
)
def anchors_fixed(spark, sf):
    return sp.anchors_fixed(fx.customers(spark, sf), [1999, 2000], [1, 7])


def _random_month(year: str, key: str) -> str:
    h = slot_of(seeded("'101'", key))
    return f"make_date({year}, CAST(1 + {h} % 12 AS INTEGER), 1)"


@query(
    "anchors_random", f"SELECT c_custkey AS id, {_random_month('2000', 'c_custkey')} AS event FROM customer"
)
def anchors_random(spark, sf):
    return sp.anchors_random(fx.customers(spark, sf), 2000, SEED)


@query(
    "sample_n",
    f"SELECT c_custkey AS id FROM customer ORDER BY {seeded(repr('101'), 'c_custkey')}, 1"
    " LIMIT (SELECT count(*) // 3 FROM customer)",
)
def sample_n(spark, sf):
    ids = fx.customers(spark, sf)
    third = ids.agg(F.expr("count(*) div 3")).scalar()
    return sp.take_seeded(ids, ["id"], third, SEED)


@query("shuffle_rows", f"SELECT id, period, n, {seeded(repr('101'), 'id', 'period')} AS shuffle_key FROM P")
def shuffle_rows(spark, sf):
    return sp.shuffle_rows(fx.panel(spark, sf).select("id", "period", "n"), SEED, ["id", "period"])


@query(
    "head_fraction",
    f"""SELECT id, period, n FROM (SELECT *, row_number() OVER (
  ORDER BY {seeded(repr('101'), 'id', 'period')}, id, period) AS rn, count(*) OVER () AS total FROM P)
WHERE rn <= total // 2""",
)
def head_fraction(spark, sf):
    """Exactly half of the rows."""
    df = settle(fx.panel(spark, sf).select("id", "period", "n"), "halved")
    return sp.first_fraction(df, 0.5, SEED, ["id", "period"])


@query(
    "one_per_id",
    f"""SELECT id, period, n FROM (SELECT *, row_number() OVER (PARTITION BY id
ORDER BY {seeded(repr('101'), 'id', 'period')}, period) AS rn FROM P) WHERE rn = 1""",
)
def one_per_id(spark, sf):
    df = fx.panel(spark, sf).select("id", "period", "n")
    return sp.one_per_id(df, SEED, ["id"], ["period"])


@query(
    "downsample",
    f"""SELECT id, target FROM T WHERE target = 1 UNION ALL (
SELECT id, target FROM T WHERE target = 0 ORDER BY {seeded(repr('101'), 'id')}, id
LIMIT (SELECT 2 * count(*) FROM T WHERE target = 1))""",
)
def downsample(spark, sf):
    return sp.downsample(fx.score_wide(spark, sf).select("id", "target"), "target", 2, SEED, ["id"])


#: Rows of one class, in seeded order, go to the folds in turn.
_FOLD = f"""CAST((row_number() OVER (PARTITION BY target ORDER BY {seeded(repr('101'), 'id')}, id) - 1) % 5 AS INTEGER)"""


@query(
    "assign_folds",
    f"SELECT id, target, {_FOLD} AS fold FROM T",
)
def assign_folds(spark, sf):
    return sp.assign_folds(fx.score_wide(spark, sf).select("id", "target"), 5, SEED, ["id"], label="target")


@query(
    "fold_split",
    f"""SELECT id, target, fold, CASE WHEN fold = 0 THEN 'validate' ELSE 'train' END AS part FROM (
SELECT id, target, {_FOLD} AS fold FROM T)""",
)
def fold_split(spark, sf):
    df = sp.assign_folds(fx.score_wide(spark, sf).select("id", "target"), 5, SEED, ["id"], label="target")
    train, validate = sp.fold_split(df, 0)
    return train.withColumn("part", F.lit("train")).unionByName(
        validate.withColumn("part", F.lit("validate"))
    )


def match_sql(name: str, ratio: str, key: str, group: str = "") -> str:
    """Matching by cumulative quotas in plain SQL; ``group`` names a ratio column or nothing."""
    g, part = (f"{group}, ", f"PARTITION BY {group}") if group else ("", "")
    groups = f"CROSS JOIN (SELECT unnest({RATIOS}) AS ratio)" if group else ""
    same = f"AND LN.{group} = U.{group}" if group else ""
    filled = " + ".join(f"(coalesce({m}, 0) <> 0)::INT" for m in fx.METRICS)
    h = slot_of("d")
    deal = key.replace("101", "101 deal", 1)
    return f"""
{name}_Q AS (SELECT {g}event, CAST(sum({ratio}) AS BIGINT) AS quota FROM E {groups} GROUP BY ALL),
{name}_LN AS (SELECT {g}event, quota, sum(quota) OVER ({part} ORDER BY event) AS hi,
                     sum(quota) OVER ({part}) AS q FROM {name}_Q),
{name}_D AS (SELECT U.*, LN.event, LN.quota FROM (SELECT H.id, {g}{key} AS m, {deal} AS d FROM H {groups}) U
             JOIN {name}_LN LN ON {h} % q >= hi - quota AND {h} % q < hi {same}),
{name}_F AS (SELECT X.id, {"X." + g if group else ""}X.event, quota, m FROM {name}_D X
             JOIN P ON P.id = X.id AND P.period <= X.event - INTERVAL 3 MONTH
                   AND P.period > X.event - INTERVAL 15 MONTH
             GROUP BY ALL HAVING sum({filled}) >= 1),
{name} AS (SELECT {g}id, event FROM (
  SELECT *, row_number() OVER (PARTITION BY {g}event ORDER BY m, id) AS rn FROM {name}_F)
  WHERE rn <= quota)"""


MATCHED = match_sql("MC", "2", seeded("'101'", "H.id"))
MATCHED_RATIOS = match_sql("MR", "ratio", seeded("'101'", "ratio", "H.id"), "ratio")


def matched(spark, sf, ratio: int = 2, p=None):
    """Controls at ``ratio`` per event whose window is not empty."""
    p = fx.panel(spark, sf) if p is None else p
    quotas = sp.control_quotas(fx.events(spark, sf), ratio)
    return sp.match_controls(
        fx.healthy(spark, sf),
        quotas,
        SEED,
        filled=lambda a: ft.filled_lag_cells(a, p, fx.METRICS),
    )


def matched_ratios(spark, sf, ratios=RATIOS, p=None):
    p = fx.panel(spark, sf) if p is None else p
    many = F.explode(F.array(*[F.lit(r) for r in ratios]))
    events = fx.events(spark, sf).withColumn("ratio", many)
    quotas = sp.control_quotas(events, F.col("ratio"), ["ratio"])
    return sp.match_controls(
        fx.healthy(spark, sf).withColumn("ratio", many),
        quotas,
        SEED,
        filled=lambda a: ft.filled_lag_cells(a, p, fx.METRICS),
        by=["ratio"],
    )


@query("match_controls", "SELECT id, event FROM MC", MATCHED)
def match_controls(spark, sf):
    return matched(spark, sf)


@query(
    "match_complete",
    f"""SELECT event, quota, CAST(0 AS BIGINT) AS open, true AS once FROM (
  SELECT event, CAST(least(2 * count(*), (SELECT count(DISTINCT H.id) FROM H JOIN P ON P.id = H.id
    AND P.period <= E.event - INTERVAL 3 MONTH AND P.period > E.event - INTERVAL 15 MONTH
    AND {" + ".join(f"(coalesce({m}, 0) <> 0)::INT" for m in fx.METRICS)} >= 1)) AS BIGINT) AS quota
  FROM E GROUP BY event)""",
)
def match_complete(spark, sf):
    """Months that stay short while an unused customer has a non-empty window there: none. The
    quota shown is what the month's own candidates allow."""
    p = fx.settled_panel(spark, sf)
    wanted = sp.control_quotas(fx.events(spark, sf), 2)
    check = lambda a: ft.filled_lag_cells(a, p, fx.METRICS)
    pool = fx.healthy(spark, sf)
    kept = settle(sp.match_controls(pool, wanted, SEED, filled=check, fill=True), "complete")
    months = wanted.agg(F.collect_list("event")).scalar()
    able = check(settle(pool.withColumn("event", F.explode(months)), "able")).filter("filled >= 1")
    able = settle(able.select("id", "event"), "able")
    spare = able.join(kept, "id", "left_anti").groupBy("event").agg(F.count("*").alias("spare"))
    all_able = able.groupBy("event").agg(F.count("*").alias("able"))
    shown = sp.control_shortfall(kept, wanted).join(all_able, "event", "left").join(spare, "event", "left")
    zero = F.lit(0).cast("long")
    repeated = kept.agg(F.count("*") == F.count_distinct("id")).scalar()
    return shown.select(
        "event",
        F.least("quota", F.coalesce("able", zero)).alias("quota"),
        F.least("missing", F.coalesce("spare", zero)).alias("open"),
        repeated.alias("once"),
    )


_TIGHT, _TIGHT_CELLS = 40, 9


@query(
    "match_exchange",
    """SELECT year, sum(quota)::BIGINT AS quota, any_value(best)::BIGINT AS kept, (sum(quota) - any_value(best))::BIGINT AS missing,
true AS once, true AS able, true AS within FROM XQ JOIN (
  SELECT year, min(beyond + coalesce(reach, 0)) AS best FROM XB LEFT JOIN XN USING (year, s) GROUP BY year) USING (year) GROUP BY year""",
    f"""XQ AS (SELECT CAST(year(event) AS INTEGER) AS year, event, {_TIGHT} * count(*) AS quota FROM E GROUP BY ALL),
XA AS (SELECT XQ.year, H.id, XQ.event FROM XQ CROSS JOIN H JOIN P ON P.id = H.id
  AND P.period <= event - INTERVAL 3 MONTH AND P.period > event - INTERVAL 15 MONTH
  GROUP BY ALL HAVING sum({" + ".join(f"(coalesce({m}, 0) <> 0)::INT" for m in fx.METRICS)}) >= {_TIGHT_CELLS}),
XM AS (SELECT year, mask, count(*) AS n FROM (
  SELECT year, id, bit_or(1 << (month(event)::INT - 1)) AS mask FROM XA GROUP BY ALL) GROUP BY ALL),
XS AS (SELECT unnest(range(0, 4096))::INT AS s),
XB AS (SELECT year, s, sum(CASE WHEN s & (1 << (month(event)::INT - 1)) = 0 THEN quota ELSE 0 END) AS beyond
  FROM XQ CROSS JOIN XS GROUP BY ALL),
XN AS (SELECT year, s, sum(n) AS reach FROM XM JOIN XS ON mask & s <> 0 GROUP BY ALL)""",
)
def match_exchange(spark, sf):
    """Tight quotas per year: the controls kept are as many as any assignment of customers to months
    allows. The SQL has the smallest cut over all sets of months."""
    p = fx.settled_panel(spark, sf)
    events = fx.events(spark, sf).withColumn("year", F.year("event"))
    wanted = settle(sp.control_quotas(events, _TIGHT, ["year"]), "wanted")
    check = lambda a: ft.filled_lag_cells(a, p, fx.METRICS)
    years = wanted.agg(F.collect_set("year")).scalar()
    pool = settle(fx.healthy(spark, sf).withColumn("year", F.explode(years)), "pool")
    kept = xc.match_exchanged(pool, wanted, SEED, check, _TIGHT_CELLS, ["year"])
    able = check(kept).groupBy("year").agg(F.min("filled").alias("least"))
    month = sp.control_shortfall(kept, wanted, ["year"]).groupBy("year").agg(
        F.sum("quota").alias("quota"), F.sum("kept").alias("kept"), F.sum("missing").alias("missing"),
        F.bool_and(F.col("missing") >= 0).alias("within"),
    )
    once = kept.groupBy("year").agg((F.count("*") == F.count_distinct("id")).alias("once"))
    both = month.join(once, "year", "left").join(able, "year", "left")
    return both.select(
        "year", "quota", "kept", "missing", F.coalesce("once", F.lit(True)).alias("once"),
        F.coalesce(F.col("least") >= _TIGHT_CELLS, F.lit(True)).alias("able"), "within",
    )


@query(
    "match_shortfall",
    """SELECT ratio, event, quota, coalesce(kept, 0) AS kept, quota - coalesce(kept, 0) AS missing
FROM MR_Q LEFT JOIN (SELECT ratio, event, count(*) AS kept FROM MR GROUP BY ALL) USING (ratio, event)""",
    MATCHED_RATIOS,
)
def match_shortfall(spark, sf):
    many = F.explode(F.array(*[F.lit(r) for r in RATIOS]))
    events = fx.events(spark, sf).withColumn("ratio", many)
    quotas = sp.control_quotas(events, F.col("ratio"), ["ratio"])
    return sp.control_shortfall(matched_ratios(spark, sf), quotas, ["ratio"])


def filled_rows(wide, metrics):
    """Wide rows with at least one lag cell that is not zero."""
    cells = ft.lag_names(metrics)
    return pj.drop_empty_rows(wide, cells, len(cells) - 1)


def _wide(spark, sf, p, anchors, metrics, annual_cols):
    anchors = settle(anchors, "anchors")
    if annual_cols:
        annual = fx.annual(spark, sf, p)
        return ft.feature_rows(anchors, p, metrics, annual, list(annual_cols))
    return ft.lag_features(anchors, p, metrics)


def event_rows(spark, sf, p, metrics, annual_cols=()):
    """Wide rows of the events with a non-empty window."""
    wide = _wide(spark, sf, p, fx.events(spark, sf), metrics, annual_cols)
    return filled_rows(wide, metrics).withColumn("status", F.lit(1))


def control_rows(spark, sf, p, metrics, annual_cols=(), ratio=2):
    wide = _wide(spark, sf, p, matched(spark, sf, ratio, p), metrics, annual_cols)
    return wide.withColumn("status", F.lit(0))


def case_control(spark, sf, ratio=2):
    """Events and matched controls as anchors, widened together in one pass."""
    p = fx.settled_panel(spark, sf)
    anchors = fx.events(spark, sf).withColumn("status", F.lit(1)).unionByName(
        matched(spark, sf, ratio, p).withColumn("status", F.lit(0))
    )
    return filled_rows(_wide(spark, sf, p, anchors, fx.METRICS, fx.ANNUAL), fx.METRICS)


_ANY = " + ".join(f"(coalesce({m}, 0) <> 0)::INT" for m in fx.METRICS)
_EVENTS_KEPT = f"""
EK AS (SELECT E.id, E.event FROM E JOIN P ON P.id = E.id
       AND P.period <= E.event - INTERVAL 3 MONTH AND P.period > E.event - INTERVAL 15 MONTH
       GROUP BY ALL HAVING sum({_ANY}) >= 1)"""
CASES = f"""{MATCHED},{_EVENTS_KEPT},
AN AS (SELECT id, event, 1 AS status FROM EK UNION ALL SELECT id, event, 0 FROM MC)"""


@query(
    "combine_classes",
    f"SELECT G.*, {', '.join(f'{c}_Y_1' for c in fx.ANNUAL)} FROM G JOIN B USING (id, event)",
    f"{CASES}, G AS ({lag_sql('AN', fx.METRICS, ['id', 'event', 'status'])}), B AS ({annual_sql('AN', fx.ANNUAL)})",
)
def combine_classes(spark, sf):
    """Stacked classes; the event rows still carry a column the controls lack."""
    p = fx.settled_panel(spark, sf)
    e = event_rows(spark, sf, p, fx.METRICS, fx.ANNUAL).withColumn("only_events", F.lit(1))
    return ds.combine_classes(e, control_rows(spark, sf, p, fx.METRICS, fx.ANNUAL))


@query(
    "class_balance",
    """SELECT CAST(year(event) AS INTEGER) AS year, count(*) AS rows,
count(*) FILTER (WHERE status = 0) AS healthy, count(*) FILTER (WHERE status = 1) AS events,
round(count(*) FILTER (WHERE status = 1) / count(*), 6) AS share,
round(count(*) FILTER (WHERE status = 0) / nullif(count(*) FILTER (WHERE status = 1), 0), 4) AS ratio,
round(sum(sales_M_1), 2) AS last_sales, round(sum(qty_Y_1), 2) AS known_qty
FROM (SELECT G.*, B.qty_Y_1 FROM G JOIN B USING (id, event)) GROUP BY 1""",
    f"{CASES}, G AS ({lag_sql('AN', fx.METRICS, ['id', 'event', 'status'])}), B AS ({annual_sql('AN', fx.ANNUAL)})",
)
def class_balance(spark, sf):
    """Orders to panel, events and matched controls, wide rows, classes per year."""
    return pr.class_balance(
        case_control(spark, sf),
        by=[F.year("event").alias("year")],
        extra=[
            F.round(F.sum("sales_M_1"), 2).alias("last_sales"),
            F.round(F.sum("qty_Y_1"), 2).alias("known_qty"),
        ],
    )


@query(
    "split_time",
    """SELECT id, event, status, CASE WHEN year(event) = 2000 THEN 'test' ELSE 'train' END AS split
FROM AN""",
    CASES,
)
def split_time(spark, sf):
    p = fx.panel(spark, sf)
    e = ft.filled_lag_cells(fx.events(spark, sf), p, fx.METRICS).filter(F.col("filled") >= 1)
    both = e.drop("filled").withColumn("status", F.lit(1)).unionByName(
        matched(spark, sf).withColumn("status", F.lit(0))
    )
    return ds.split_time(both, fx.TEST_YEAR)


_LAGS = ", ".join(f"{m}_M_{i}" for m in fx.METRICS for i in range(1, 13))
_YEAR = ", ".join(f"{c}_Y_1" for c in fx.ANNUAL)


@query(
    "monthly_sets",
    f"""SELECT *, CAST(month(event) AS INTEGER) AS month,
CASE WHEN year(event) = 2000 THEN 'test' ELSE 'train' END AS split FROM (
  SELECT id, event, {_LAGS}, {_YEAR}, 0 AS status FROM HK JOIN HB USING (id, event)
  UNION ALL SELECT id, event, {_LAGS}, {_YEAR}, 1 FROM G JOIN GB USING (id, event))""",
    f"""{_EVENTS_KEPT}, G AS ({lag_sql('EK', fx.METRICS)}), GB AS ({annual_sql('EK', fx.ANNUAL)}),
DL AS (SELECT id, period AS event, {", ".join(f"CAST(coalesce(lag({m}, {i + 2}) OVER w, 0) AS DOUBLE) AS {m}_M_{i}" for m in fx.METRICS for i in range(1, 13))}
       FROM D WINDOW w AS (PARTITION BY id ORDER BY period)),
HK AS (SELECT * FROM DL WHERE {" + ".join(f"n_M_{i}" for i in range(1, 13))} > 0 AND NOT EXISTS (
    SELECT 1 FROM EK WHERE EK.id = DL.id AND month(EK.event) = month(DL.event))),
HB AS ({annual_sql('HK', fx.ANNUAL)})""",
)
def monthly_sets(spark, sf):
    """Every customer at every month against the events of that calendar month, with all lags and
    the annual block."""
    return month_rows(spark, sf, fx.settled_panel(spark, sf), fx.METRICS, fx.ANNUAL)


def month_rows(spark, sf, p, metrics, annual_cols=()):
    """The month sets with the lags of these metrics and these annual columns."""
    healthy = filled_rows(ft.lag_features_dense(p, metrics), metrics)
    if annual_cols:
        healthy = ft.annual_features_dense(healthy, fx.annual(spark, sf, p), list(annual_cols))
    events = event_rows(spark, sf, p, metrics, annual_cols)
    return ds.monthly_sets(healthy.withColumn("status", F.lit(0)), events, fx.TEST_YEAR)


@query(
    "ratio_sets",
    f"""SELECT *, CASE WHEN year(event) = 2000 THEN 'test' ELSE 'train' END AS split FROM (
  SELECT ratio, id, event, status, {_LAGS}, {_YEAR} FROM GC JOIN CB USING (ratio, id, event)
  UNION ALL SELECT ratio, id, event, 1, {_LAGS}, {_YEAR} FROM G JOIN GB USING (id, event)
  CROSS JOIN (SELECT unnest({RATIOS}) AS ratio))""",
    f"""{MATCHED_RATIOS},{_EVENTS_KEPT}, G AS ({lag_sql('EK', fx.METRICS)}), GB AS ({annual_sql('EK', fx.ANNUAL)}),
MS AS (SELECT *, 0 AS status FROM MR),
GC AS ({lag_sql('MS', fx.METRICS, ['ratio', 'id', 'event', 'status'])}),
CB AS ({annual_sql('MS', fx.ANNUAL, 'X.ratio, ')})""",
)
def ratio_sets(spark, sf):
    """Controls of every ratio and all events, with all lags and the annual block."""
    p = fx.settled_panel(spark, sf)
    controls = _wide(spark, sf, p, matched_ratios(spark, sf, p=p), fx.METRICS, fx.ANNUAL)
    events = event_rows(spark, sf, p, fx.METRICS, fx.ANNUAL)
    return ds.ratio_sets(controls.withColumn("status", F.lit(0)), events, RATIOS, fx.TEST_YEAR)


@query(
    "ratio_audit",
    f"""SELECT ratio, count(*) AS rows, count(*) FILTER (WHERE status = 0) AS healthy,
count(*) FILTER (WHERE status = 1) AS events,
round(count(*) FILTER (WHERE status = 1) / count(*), 4) AS share FROM (
  SELECT ratio, 0 AS status FROM MR
  UNION ALL SELECT ratio, 1 FROM EK CROSS JOIN (SELECT unnest({RATIOS}) AS ratio)) GROUP BY 1""",
    f"{MATCHED_RATIOS},{_EVENTS_KEPT}",
)
def ratio_audit(spark, sf):
    p = fx.panel(spark, sf)
    e = ft.filled_lag_cells(fx.events(spark, sf), p, fx.METRICS).filter(F.col("filled") >= 1)
    controls = matched_ratios(spark, sf).withColumn("status", F.lit(0))
    sets = ds.ratio_sets(
        controls, e.drop("filled").withColumn("status", F.lit(1)), RATIOS, fx.TEST_YEAR
    )
    return ds.ratio_audit(sets)


_TRAIN = [1996, 1997, 1998, 1999]


@query(
    "yearly_combine",
    f"""SELECT id, event, status FROM (
  SELECT *, row_number() OVER (PARTITION BY id, status
    ORDER BY {seeded(repr('101'), 'id', 'status', 'event')}, event) AS rn FROM HE) WHERE rn = 1""",
    f"""W AS (SELECT c_custkey AS id, {_random_month('y', 'c_custkey')} AS event, y FROM customer
      CROSS JOIN (SELECT unnest({_TRAIN}) AS y)),
ET AS (SELECT id, event FROM E WHERE year(event) IN ({", ".join(map(str, _TRAIN))})),
WH AS (SELECT *, row_number() OVER (PARTITION BY year(event)
    ORDER BY {seeded(repr('101'), 'id', 'event')}, id, event) AS rn, count(*) OVER (PARTITION BY year(event)) AS total FROM W),
HE AS (
  SELECT id, event, 0 AS status FROM WH WHERE id NOT IN (SELECT id FROM ET)
    AND (y <> 1996 OR rn <= total // 2)
  UNION ALL SELECT id, event, 1 FROM ET)""",
)
def yearly_combine(spark, sf):
    ids = fx.customers(spark, sf)
    h = ds.stack(*[sp.anchors_random(ids, y, SEED) for y in _TRAIN]).withColumn("status", F.lit(0))
    e = fx.events(spark, sf).withColumn("status", F.lit(1))
    return ds.yearly_combine(h, e, _TRAIN, 1996, SEED)


@query(
    "class_weights",
    """SELECT status, rows, share, weight, round(least(p0, p1) * 2 * 0.632::DOUBLE, 6) AS sample_fraction FROM (
  SELECT unnest([0, 1]) AS status, unnest([n - n1, n1]) AS rows, p0, p1,
         round(unnest([p0, p1]), 6) AS share, round(unnest([p1, p0]), 6) AS weight
  FROM (SELECT count(*) AS n, count(*) FILTER (WHERE target = 1) AS n1,
               count(*) FILTER (WHERE target = 1) / count(*) AS p1,
               count(*) FILTER (WHERE target = 0) / count(*) AS p0 FROM T))""",
)
def class_weights(spark, sf):
    return pr.class_weights(fx.score_wide(spark, sf), "target")


@query(
    "corr_matrix",
    " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 2) AS r FROM P"
        for a in ["n", "sales", "avg_price", "max_price"]
        for b in ["n", "sales", "avg_price", "max_price"]
    ),
)
def corr_matrix(spark, sf):
    return pr.corr_matrix(fx.panel(spark, sf), ["n", "sales", "avg_price", "max_price"])


@query(
    "summarize",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS "column", count({c}) AS n, count(*) FILTER (WHERE {c} IS NULL) AS nulls,
round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS sd,
CAST(min({c}) AS DOUBLE) AS low, CAST(max({c}) AS DOUBLE) AS high FROM D"""
        for c in ["n", "sales", "max_price"]
    ),
)
def summarize(spark, sf):
    s = pr.summarize(fx.dense_panel(spark, sf), ["n", "sales", "max_price"])
    return s.withColumns({"mean": F.round("mean", 4), "sd": F.round("sd", 4)})


@query(
    "column_quartiles",
    " UNION ALL ".join(
        f"""SELECT "column", share, round(value, 6) AS value FROM (SELECT '{c}' AS "column",
unnest([0.25, 0.5, 0.75]::DOUBLE[]) AS share, unnest(quantile_cont({c}::DOUBLE, [0.25, 0.5, 0.75])) AS value FROM D)"""
        for c in ["n", "sales", "avg_price", "max_price"]
    ),
)
def column_quartiles(spark, sf):
    """Exact quartiles and medians of the dense panel."""
    panel = settle(fx.dense_panel(spark, sf), "dense")
    return sm.quantiles(panel, ["n", "sales", "avg_price", "max_price"]).withColumn("value", F.round("value", 6))


@query(
    "text_levels",
    """SELECT "column", level, rows, CAST(rank AS INTEGER) AS rank FROM (
SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY rows DESC, level NULLS FIRST) AS rank FROM (
SELECT 'sector' AS "column", sector AS level, count(*) AS rows FROM D GROUP BY 2
UNION ALL SELECT 'status', CAST(status AS VARCHAR), count(*) FROM D GROUP BY 2)) WHERE rank <= 6""",
)
def text_levels(spark, sf):
    """The most frequent values of the panel's categories."""
    return sm.text_levels(fx.dense_panel(spark, sf), ["sector", "status"])


@query(
    "row_audit",
    """SELECT year, count(*) AS start_rows, count(*) FILTER (WHERE NOT x) AS rows_left,
count(*) FILTER (WHERE x) AS removed, round(count(*) FILTER (WHERE x) / count(*) * 100, 2) AS removed_pct,
round(count(*) FILTER (WHERE NOT x) / 12, 4) AS entities_left
FROM (SELECT year, max(CASE WHEN sector = 'X' THEN 1 ELSE 0 END) OVER (PARTITION BY id, year) = 1 AS x FROM P)
GROUP BY 1""",
)
def row_audit(spark, sf):
    p = fx.panel(spark, sf)
    return pr.row_audit(p, ex.exclude_any(p, F.col("sector") == "X"), ["year"])
