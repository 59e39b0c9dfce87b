"""Time the headline queries and print one JSON line.

Every query is run to the end (all rows, all columns, into a sink that discards them), once to warm
up and then BENCH_RUNS times (2); the median counts.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from lakeops import catalog  # noqa: E402
from lakeops.session import get_spark  # noqa: E402

HEADLINE = [
    "agg_basic", "three_way_join", "topn_per_group", "rank_ties", "running_total", "percentiles", "cdc_latest", "cdc_merge_soft",
    "ledger_daily_close", "daily_account_summary", "exec_daily_close", "pit_known_vs_restated", "restatement_drift",
    "velocity_alerts", "rolling_sum", "sessionize", "breach_runs", "price_intervals", "asof_price", "range_join_grid",
    "resample_hourly", "outage_events", "funnel_hourly", "cdr_rating", "kpi_pivot", "feat_usage", "feat_billing",
    "assemble_360", "ledger_reconcile", "variance_report", "psi_numeric", "erase", "compact_sort", "time_travel",
]


def main() -> None:
    root = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 8))
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    shared = tempfile.mkdtemp(prefix="lakeops-bench-")  # one machine: its own folder is shared by all tasks
    spark = get_spark("bench", f"local[{cpus}]", cpus, **{"spark.checkpoint.dir": shared,
        "spark.driver.memory": "16g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    registered = catalog.queries()
    names = sys.argv[1:] or HEADLINE
    seconds = {}
    for name in names:
        times = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            registered[name](spark, root).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times[1:] or times), 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(root.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
