"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores.
"""

from __future__ import annotations

import json
import os
import time

from panelwatch.plans import all_queries
from panelwatch.session import local_session

HEADLINE = (
    "parse_numeric",
    "line_classes_documents",
    "column_profile",
    "project_master",
    "anomaly_union",
    "cross_validation",
    "panel_features",
    "panel_features_sparse",
    "forward_labels",
    "supervised_schedule",
    "label_accounting",
    "history_profile",
    "maturity_windows",
    "ranking_metrics",
    "reliability_bins",
    "score_distribution",
    "audit_slices",
    "future_drift",
    "intervention_policies",
    "change_feed",
    "overview_kpis",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session("bench", cores=cpus, shuffle_partitions=int(cpus))
    spark.sparkContext.setLogLevel("ERROR")
    queries = all_queries()
    # One untimed run loads the JVM and the Python side.
    queries["label_positives_by_month"](spark, folder).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in HEADLINE:
        started = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
