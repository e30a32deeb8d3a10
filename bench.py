"""Headline queries at one scale; prints one JSON line.

Each query runs twice into a ``noop`` sink and the faster run counts, so that
code generation and JVM warm-up are not what is measured.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from lakestate.plans import catalog
from lakestate.session import local_session

HEADLINE = [
    "state_resolution", "state_timeline", "active_edges", "next_boundary",
    "entity_resolution", "capsule_search", "bm25_budget", "graph_compile",
    "record_build", "inventory_root", "record_diff", "merkle_tree", "merkle_diff", "merkle_incremental_add",
    "opaque_descriptors", "byte_bounded_pages", "writeback_mutations", "feed_numbers", "append_classify",
    "slot_retractions", "capsule_build", "artifact_as_of", "markdown_files", "policy_replication",
]


def main() -> None:
    root = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = sys.argv[1:]
    spark = local_session(cpus, "bench")
    times: dict[str, float] = {}
    for name in HEADLINE:
        if only and name not in only:
            continue
        best = None
        for _ in range(2):
            started = time.perf_counter()
            catalog.QUERIES[name](spark, root).write.format("noop").mode("overwrite").save()
            spent = time.perf_counter() - started
            best = spent if best is None else min(best, spent)
        times[name] = round(best, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline_total_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(root).removeprefix("sf"), "cpus": cpus,
    }))


if __name__ == "__main__":
    main()
