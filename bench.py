"""Times the headline queries: one warm-up, then the median of three runs each.

Prints one JSON line. ``BENCH_SF_DIR``, ``BENCH_CPUS`` and ``BENCH_QUERIES`` (comma
separated names, or ``all``) choose the data, the cores and the queries.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from branchtally.driver import QUERIES
from branchtally.session import local_session

HEADLINE = (
    "report_accumulated", "report_active_users", "report_static_count", "report_trade_volume",
    "report_guarantee", "report_va_volume", "report_balance_update",
    "scan_delimited", "header_midfile_keep_both_sides", "encoding_fallback",
    "lookup_left", "lookup_first_hit", "lookup_large_reference", "pivot_multi_sum", "best_mapping",
)


def run(spark, sf_dir: str, name: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    chosen = os.environ.get("BENCH_QUERIES", "")
    names = list(QUERIES) if chosen == "all" else [n for n in chosen.split(",") if n] or list(HEADLINE)
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "branchtally-bench")
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in names:
        run(spark, sf_dir, name)
        times[name] = round(statistics.median(run(spark, sf_dir, name) for _ in range(3)), 3)
    print(
        json.dumps(
            {
                "metric": "headline queries, sum of warm medians",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
