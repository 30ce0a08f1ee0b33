"""Times headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from schedlake.queries import QUERIES  # noqa: E402
from schedlake.session import local_session  # noqa: E402

HEADLINE = [
    "cron_occurrences", "next_fires", "cron_checks", "due_at_polls", "reconciliation", "cron_dispatch",
    "insert_if_absent", "executions_with_definition", "pending_queue", "execution_stats_by_job",
    "execution_stats_cube", "concurrency", "pool_load", "latency_summary", "current_state", "attempts",
    "overlapping_runs", "event_executions", "apply_outcomes", "retry_decisions", "handler_outcomes",
    "trigger_stream_ingest",
]
RUNS = 2


def run(spark, name: str, sf_dir: str) -> float:
    """Seconds to build, plan and fully execute a query, every column produced."""
    begin = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - begin


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, partitions=int(cpus) if cpus.isdigit() else 8, app="bench")
    spark.sparkContext.setLogLevel("ERROR")
    times = {name: round(min(run(spark, name, sf_dir) for _ in range(RUNS)), 3) for name in HEADLINE}
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": Path(sf_dir).name.removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
