"""Time the headline queries: one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from feedweave.session import local_session  # noqa: E402
from workload.queries import all_queries  # noqa: E402

HEADLINES = [
    "change_feed_scan",
    "resume_after",
    "feed_pages",
    "read_envelope_pages",
    "incremental_window",
    "dedup_in_run",
    "merge_flagship",
    "merge_outcomes",
    "merged_state",
    "drift_findings",
    "drift_route",
    "map_customer",
    "map_order",
    "content_fingerprint",
    "quarantine_append",
    "drift_event_upsert",
    "run_counters",
    "run_incremental",
    "change_events",
    "outbox_publish_pass",
    "consume_if_newer",
    "feed_health",
    "overview_totals",
    "lag_series",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session("bench", cores)
    queries = all_queries()
    # The first job of a session pays for starting up; it is not part of any query.
    queries["incremental_window"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in HEADLINES:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline queries, total wall time",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(sf_dir).name.removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
