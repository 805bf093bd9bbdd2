"""From repeated rows to dense lags on a panel stored by entity."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from duskline.operators import exclusion as ex, features as ft, timeline as tl
from duskline.plans import fixtures as fx
from duskline.plans.catalog import query
from duskline.plans.cleaning_queries import _EXEMPT
from duskline.plans.timeline_queries import _dense_lag_sql
from duskline.sources.clustered import by_entity, cluster_panel
from duskline.sources.scratch import settle

_LAGGED = ["n", "sales"]
#: Customers per bucket: with some hundred months each, a task sorts about a million rows.
A_BUCKET = 10_000


def stored_panel(spark, sf) -> DataFrame:
    """The dense panel by entity, every seventh entity's rows twice. Buckets grow with the customers."""
    rows = fx.dense_panel(spark, sf).withColumn("take", F.lit(0))
    again = rows.filter("id % 7 = 0").withColumn("n", F.col("n") + 1).withColumn("take", F.lit(1))
    buckets = math.ceil(fx.customers(spark, sf).count() / A_BUCKET)
    buckets = max(buckets, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return cluster_panel(rows.unionByName(again), "clustered", buckets)


def lags_by_entity(panel: DataFrame) -> DataFrame:
    """Single rows, whole-entity exclusions, cut at the event, lags of every month."""
    single = tl.dedupe(panel, ["id", "period"], [F.col("take")]).drop("take")
    kept = ex.clean_rows(single, fx.is_event(), F.col("sector") == "X", "active", fx.METRICS, periods=2)
    return ft.lag_features_dense(tl.truncate_after_event(kept, fx.is_event()), _LAGGED)


@query(
    "clustered_lags",
    _dense_lag_sql(_LAGGED).replace("FROM D\nWHERE id IN (SELECT id FROM P)", "FROM CD"),
    f"""
{_EXEMPT.strip()},
X AS (SELECT DISTINCT id, year FROM D WHERE sector = 'X'),
D0 AS (SELECT * FROM D WHERE NOT EXISTS (SELECT 1 FROM X WHERE X.id = D.id AND X.year = D.year)),
Y AS (SELECT id, year FROM D0 GROUP BY 1, 2 HAVING sum(active) < 2),
D1 AS (SELECT * FROM D0 WHERE NOT EXISTS (SELECT 1 FROM Y WHERE Y.id = D0.id AND Y.year = D0.year
       AND NOT EXISTS (SELECT 1 FROM EX WHERE EX.id = Y.id AND EX.exempt_until >= Y.year))),
N1 AS (SELECT id, year FROM D1 WHERE month(period) = 12
       AND n IS NULL AND sales IS NULL AND max_price IS NULL
       AND NOT EXISTS (SELECT 1 FROM EX WHERE EX.id = D1.id AND EX.exempt_until >= D1.year)),
K1 AS (SELECT * FROM D1 WHERE NOT EXISTS (SELECT 1 FROM N1 WHERE N1.id = D1.id AND N1.year = D1.year)),
F1 AS (SELECT id, min(period) AS event FROM K1 WHERE status = 5 GROUP BY id),
K2 AS (SELECT K1.* FROM K1 LEFT JOIN F1 USING (id) WHERE event IS NULL OR period <= event),
CD AS (SELECT C.id, C.period, n, sales FROM (
  SELECT id, M.period FROM (SELECT DISTINCT id FROM K2) CROSS JOIN M
  WHERE M.period BETWEEN (SELECT min(period) FROM K2) AND (SELECT max(period) FROM K2)) C
  LEFT JOIN K2 ON K2.id = C.id AND K2.period = C.period)""",
)
def clustered_lags(spark, sf):
    """Cleaning and dense lags without a shuffle of the stored panel."""
    with by_entity(spark):
        return settle(lags_by_entity(stored_panel(spark, sf)), "clustered_lags")
