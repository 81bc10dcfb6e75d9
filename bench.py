"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from sparkwatch.session import local_session
from sparkwatch.workload.queries import QUERIES

HEADLINE = [
    "request_rate",
    "grid_resample",
    "grid_dense",
    "seasonal_naive",
    "ewma",
    "k_sigma_alerts",
    "threshold_cost_report",
    "features_all",
    "quantile_ladder",
    "accuracy_by_metric",
    "honesty",
    "upstream_hops",
    "label_incidents",
    "fault_overlay",
    "incident_records",
    "impact_report",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cores, partitions=int(cores) if cores.isdigit() else 8)
    QUERIES["event_rate"](spark, folder).write.format("noop").mode("overwrite").save()
    seconds: dict[str, float] = {}
    for name in names:
        started = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": seconds, "sf": os.path.basename(folder)}))
    spark.stop()


if __name__ == "__main__":
    main()
