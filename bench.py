"""Time the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; print one JSON line.

Every query runs once to warm up and then `BENCH_RUNS` times; its best run counts.
Results are computed in full and discarded, as a writer would consume them.
"""

from __future__ import annotations

import json
import os
import time

from signalbox.plans.catalog import QUERIES
from signalbox.session import build_session

HEADLINE = (
    "tool_analytics",
    "tool_usage_recent_sessions",
    "stats_totals",
    "method_counts",
    "query_messages",
    "parse_messages",
    "to_log_rows",
    "evaluate_policy",
    "evaluate_policy_table",
    "scrub_text",
    "scrub_json",
    "pii_report",
    "correlate_lists",
    "resolve_approvals",
    "apply_approvals",
    "prune_tools_top_k",
    "rebuild_list_responses",
    "governed_messages",
    "stream_messages",
    "stream_correlation",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = build_session(
        "signalbox-bench",
        master=f"local[{cpus}]",
        **{
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g"),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in names:
        best = None
        for run in range(runs + 1):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - start
            if run and (best is None or took < best):
                best = took
        times[name] = round(best, 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
