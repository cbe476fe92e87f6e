"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS choose data and cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from vislens.plans.catalog import QUERIES  # noqa: E402
from vislens.session import local_session  # noqa: E402

HEADLINE = (
    "exact_topk", "postfilter_topk", "approx_topk", "landing_rank", "eligibility_eval", "containment_cost", "fifo_queue", "policy_transitions",
    "exposure_unvetted", "freshness", "restricted_time", "poisoned_rate", "dedup_groups", "hard_negative_rules", "shared_6gram", "knn_novelty",
    "select_threshold", "window_tail_latency", "run_summary", "illegal_transitions", "prr_stream",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    # One small query of each kind starts the JVM's and Python's workers.
    for name in ("kth_cutoff", "decision_mix"):
        QUERIES[name](spark, sf_dir).collect()
    times = {}
    for name in only:
        t = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t, 3)
    spark.stop()
    sf = os.path.basename(os.path.normpath(sf_dir)).removeprefix("sf")
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()
