"""Event dates, truncation, lag and annual features."""

from __future__ import annotations

from pyspark.sql import functions as F

from duskline.functions.dates import known_year
from duskline.operators import features as ft, profiles as pr, projection as pj, timeline as tl
from duskline.plans import fixtures as fx
from duskline.plans.catalog import query
from duskline.sources.scratch import settle


@query("event_dates", "SELECT id, event FROM E")
def event_dates(spark, sf):
    return tl.event_dates(fx.panel(spark, sf), fx.is_event())


@query(
    "truncate_after_event",
    "SELECT P.* FROM P LEFT JOIN E USING (id) WHERE event IS NULL OR period <= event",
)
def truncate_after_event(spark, sf):
    return tl.truncate_after_event(fx.panel(spark, sf), fx.is_event())


@query("event_month", "SELECT id, event FROM E WHERE month(event) = 1")
def event_month(spark, sf):
    return tl.event_month(fx.events(spark, sf), 1)


@query("event_floor", "SELECT id, event FROM E WHERE NOT (year(event) = 1995 AND month(event) < 7)")
def event_floor(spark, sf):
    return tl.event_floor(fx.events(spark, sf), 1995)


@query("event_counts", "SELECT event, count(*) AS n FROM E GROUP BY event")
def event_counts(spark, sf):
    return tl.event_counts(fx.events(spark, sf))


KNOWN_SQL = "CAST(year(event) - CASE WHEN month(event) < 7 THEN 2 ELSE 1 END AS INTEGER)"


@query("known_year", f"SELECT id, event, {KNOWN_SQL} AS known_year FROM E")
def known_year_query(spark, sf):
    return fx.events(spark, sf).withColumn("known_year", known_year("event"))


def annual_sql(anchors: str, cols: list[str], extra: str = "") -> str:
    cells = ", ".join(f"coalesce(A.{c}, 0) AS {c}_Y_1" for c in cols)
    return f"""SELECT X.id, X.event, {extra}{cells} FROM {anchors} X
LEFT JOIN A ON A.id = X.id AND A.year = {KNOWN_SQL}"""


@query("annual_features", annual_sql("E", fx.ANNUAL))
def annual_features(spark, sf):
    anchors = settle(fx.events(spark, sf), "anchors")
    return ft.annual_features(anchors, fx.annual(spark, sf), fx.ANNUAL)


def lag_sql(anchors: str, metrics: list[str], keys: list[str] = ("id", "event"), src="P") -> str:
    """Lags by date arithmetic and conditional aggregates."""
    cells = ", ".join(
        f"CAST(coalesce(max(CASE WHEN period = event - INTERVAL {i + 2} MONTH THEN {m} END), 0)"
        f" AS DOUBLE) AS {m}_M_{i}"
        for m in metrics
        for i in range(1, 13)
    )
    names = ", ".join(f"X.{k}" for k in keys)
    return f"""SELECT {names}, {cells} FROM {anchors} X LEFT JOIN {src} Q ON Q.id = X.id
GROUP BY {names}"""


@query("lag_features", lag_sql("E", fx.METRICS))
def lag_features(spark, sf):
    anchors = settle(fx.events(spark, sf), "anchors")
    return ft.lag_features(anchors, fx.panel(spark, sf), fx.METRICS)


def _dense_lag_sql(metrics: list[str]) -> str:
    cells = ", ".join(
        f"CAST(coalesce(lag({m}, {i + 2}) OVER w, 0) AS DOUBLE) AS {m}_M_{i}"
        for m in metrics
        for i in range(1, 13)
    )
    return f"""SELECT id, period AS event, {cells} FROM D
WHERE id IN (SELECT id FROM P) WINDOW w AS (PARTITION BY id ORDER BY period)"""


@query("lag_features_dense", _dense_lag_sql(["n", "sales"]))
def lag_features_dense(spark, sf):
    return ft.lag_features_dense(fx.panel(spark, sf), ["n", "sales"])


@query(
    "annual_features_dense",
    "SELECT G.id, G.event, n_M_1, sales_Y_1, qty_Y_1 FROM G JOIN B USING (id, event)",
    f"G AS ({_dense_lag_sql(['n'])}), B AS ({annual_sql('G', ['sales', 'qty'])})",
)
def annual_features_dense(spark, sf):
    """The last known month and year at every month of every customer with orders."""
    p = fx.settled_panel(spark, sf)
    dense = ft.lag_features_dense(p, ["n"]).select("id", "event", "n_M_1")
    return ft.annual_features_dense(dense, fx.annual(spark, sf, p), ["sales", "qty"])


@query(
    "feature_rows",
    f"""SELECT G.*, {", ".join(f"{c}_Y_1" for c in fx.ANNUAL)}, 1 AS status
FROM G JOIN B ON B.id = G.id AND B.event = G.event
WHERE {" + ".join(f"(coalesce({m}_M_{i}, 0) <> 0)::INT" for m in fx.METRICS for i in range(1, 13))} >= 1""",
    f"G AS ({lag_sql('E', fx.METRICS)}), B AS ({annual_sql('E', fx.ANNUAL)})",
)
def feature_rows(spark, sf):
    cells = ft.lag_names(fx.METRICS)
    anchors = settle(fx.events(spark, sf), "anchors")
    wide = ft.feature_rows(
        anchors, fx.panel(spark, sf), fx.METRICS, fx.annual(spark, sf), fx.ANNUAL, 1
    )
    return pj.drop_empty_rows(wide, cells, len(cells) - 1)


@query(
    "class_calendar",
    "SELECT K.status, K.month, "
    + ", ".join(f"count(*) FILTER (WHERE y = {y}) AS y{y}" for y in fx.YEARS)
    + f", count(*) FILTER (WHERE y NOT IN ({', '.join(map(str, fx.YEARS))})) AS other_years"
    + """ FROM (SELECT * FROM (SELECT unnest([0, 1]) AS status),
(SELECT CAST(unnest(range(1, 13)) AS INTEGER) AS month)) K LEFT JOIN Z USING (status, month) GROUP BY 1, 2""",
    """Z AS (
  SELECT 1 AS status, CAST(month(event) AS INTEGER) AS month, year(event) AS y FROM E
  UNION ALL SELECT 0, CAST(month(period) AS INTEGER), year(period) FROM P
  WHERE id NOT IN (SELECT id FROM E))""",
)
def class_calendar(spark, sf):
    e = fx.events(spark, sf)
    h = fx.panel(spark, sf).join(e, "id", "left_anti")
    both = e.select("event", F.lit(1).alias("status")).unionByName(
        h.select(F.col("period").alias("event"), F.lit(0).alias("status"))
    )
    return pr.class_calendar(both, fx.YEARS)


@query(
    "event_age",
    """SELECT CAST(year(event) AS INTEGER) AS year, CAST(month(event) AS INTEGER) AS month,
round(avg(age), 6) AS mean_age, count(age) AS n FROM (
  SELECT E.event, date_diff('month', min(period), E.event) AS age FROM E JOIN P USING (id)
  GROUP BY E.id, E.event) GROUP BY 1, 2""",
)
def event_age(spark, sf):
    """Months from the first panel row to the event, averaged per event month."""
    born = fx.panel(spark, sf).groupBy("id").agg(F.min("period").alias("born"))
    age = F.months_between("event", "born")
    df = fx.events(spark, sf).join(born, "id").select(
        F.year("event").alias("year"), F.month("event").alias("month"), age.alias("age")
    )
    return pr.mean_by(df, "age", ["year", "month"]).withColumn("mean_age", F.round("mean_age", 6))
