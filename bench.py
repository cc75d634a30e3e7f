"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores.
Each query runs once to warm up and is then timed BENCH_RUNS times (default 3); the median counts.
"""

from __future__ import annotations

import json
import os
import pathlib
import statistics
import time

from memgov.plans import catalog
from memgov.session import build_session

HEADLINE = (
    "retain_outcomes_by_writer", "scan_documents", "rule_scan_documents", "split_instruction_turns",
    "recalled_memory_decisions", "retain_validation", "canonical_digests", "request_families",
    "quarantine_stats", "scoped_pending", "queue_page", "merged_items", "reviewed_items",
    "maintenance_run", "audit_trail", "offered_load", "writer_quota", "shared_quota",
    "capacity_by_count", "evidence_admission", "log_throttle", "route_report", "denied_endpoints",
    "operations_report", "legacy_import",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    catalog.load_all()
    spark = build_session(f"local[{cpus}]", cpus)
    spark.sparkContext.setLogLevel("OFF")

    def once(name: str) -> float:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    seconds = {}
    for name in HEADLINE:
        once(name)
        seconds[name] = round(statistics.median(once(name) for _ in range(runs)), 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": pathlib.Path(folder).name.removeprefix("sf"), "cpus": cpus,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
