"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from duskline.operators import features as ft, profiles as pr  # noqa: E402
from duskline.plans import fixtures as fx, load  # noqa: E402
from duskline.session import local_session  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
WIDTH = 17
METRICS = ["n", "sales", "avg_price", "max_price", "year"]

HEADLINE = [
    "scan_panel", "null_profile", "category_risk", "map_category", "ratio_score", "clean_rows",
    "truncate_after_event", "event_counts", "annual_features", "lag_features",
    "lag_features_dense", "match_controls", "combine_classes", "class_balance", "monthly_sets",
    "ratio_sets", "yearly_combine", "downsample", "one_per_id", "corr_matrix", "class_report",
    "threshold_kappa", "threshold_sweep", "roc_auc", "det_eer", "best_fold", "smote",
    "forest_scores", "cross_scores", "company_clean", "match_complete",
]


def wide_lags(spark, sf):
    """17 metrics x 12 lags for every customer at one month of each year."""
    base = fx.panel(spark, sf)
    metrics = [f"m{i}" for i in range(WIDTH)]
    panel = base.select(
        "id", "period", *[(F.col("sales") * (i + 1)).alias(m) for i, m in enumerate(metrics)]
    )
    dates = F.array(*[F.make_date(F.lit(y), F.lit(3), F.lit(1)) for y in fx.YEARS[1:]])
    anchors = fx.customers(spark, sf).select("id", F.explode(dates).alias("event"))
    return ft.lag_features(anchors, panel, metrics)


def wide_corr(spark, sf):
    """Correlations of fifty columns."""
    base = fx.panel(spark, sf)
    cols = [(F.col(c) * F.rand(i) if i else F.col(c)).alias(f"{c}_{i}") for i in range(10) for c in METRICS]
    wide = base.select(*cols)
    return pr.corr_matrix(wide, wide.columns)


def run(df) -> None:
    df.write.mode("overwrite").format("noop").save()


def main() -> None:
    spark = local_session(CPUS, "bench")
    queries, _ = load()
    timed = {name: queries[name] for name in HEADLINE} | {"lag_features_17x12": wide_lags, "corr_matrix_50": wide_corr}
    run(queries["event_counts"](spark, SF_DIR))  # start the engine
    seconds = {}
    for name, fn in timed.items():
        start = time.perf_counter()
        run(fn(spark, SF_DIR))
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(SF_DIR.rstrip("/")),
            }
        )
    )


if __name__ == "__main__":
    main()
