"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR names the tables (default sf 0.1), BENCH_CPUS the local threads.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from pathlib import Path

from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = (
    "filter_audit", "cross_source_filter", "device_dedup", "device_dataset", "join_fanout", "reconciliation",
    "site_clusters", "metric_domain", "cluster_urgency", "location_summary_horizon", "site_summary",
    "top_overdue_sites", "site_risk_scatter", "state_exposure", "source_lifecycle_mix", "model_hotspots",
    "findings_kpis", "pred_state_risk", "confidence_hist", "rep_days_hist", "rep_days_kde", "rep_source_mix",
    "rep_category_heat", "rep_owner_box", "rep_cost_bucket", "site_priority_matrix", "missing_rates", "ml_impute",
    "split_stats", "ml_train_score", "weight_grid", "class_report", "macro_auc", "roc_points", "eval_loss",
)


def main() -> None:
    directory = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("fleetspan-bench")
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="fleetspan-bench-"))
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from checks.registry import QUERIES
    from fleetspan.operators.sizing import release_tables

    names = sys.argv[1:] or HEADLINE
    QUERIES["findings_kpis"](spark, directory).collect()  # starts the session's caches and compiler
    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, directory).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    release_tables(spark)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(directory).name.removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
