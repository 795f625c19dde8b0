"""Times the headline queries on $BENCH_SF_DIR (default /root/testdata/sf0.1)
with local[$BENCH_CPUS] and prints one JSON line.

Every query is executed completely through the `noop` sink (no result is
collected to the driver); the time includes the operator's own scalar jobs
(statistics passes, checkpoints).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "missingness_dirty_events",
    "column_profile_dirty_events",
    "duplicate_counts_dirty_events",
    "numeric_outliers_lineitem",
    "histogram_lineitem",
    "top_categories_orders",
    "quality_checks_dirty_events",
    "pii_scan_documents",
    "pii_scan_pages",
    "weekly_series_orders",
    "timeseries_sum_d_orders",
    "period_change_orders",
    "anomalies_orders",
    "top_drivers_orders",
    "drop_pair_duplicates_dirty_events",
    "winsorize_dirty_events",
    "clean_dirty_events",
    "suggest_roles_orders",
    "infer_columns_orders",
    "regression_metrics_lineitem",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    from tablelens.plans.registry import QUERIES
    from tablelens.session import local_session

    spark = local_session(cpus, "tablelens-bench")
    # warm-up (JVM, codegen caches) on a tiny query, not timed
    QUERIES["table_summary_customer"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    names = [n for n in HEADLINE if n in QUERIES]
    only = os.environ.get("BENCH_ONLY")
    if only:
        names = [n for n in names if any(p in n for p in only.split(","))]
    times: dict[str, float] = {}
    for name in names:
        t0 = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
        print(f"{name}: {times[name]:.2f}s", file=sys.stderr)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({
        "metric": "headline_total",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(sf) if sf.replace(".", "").isdigit() else sf,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
