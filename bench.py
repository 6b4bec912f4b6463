"""Benchmark: run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]
and print one JSON line with seconds per query.

Each query is forced to completion with a ``noop`` write (all rows
produced, nothing collected to the driver).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from faultline.plans import registry  # noqa: E402
from faultline.session import get_session  # noqa: E402

HEADLINE = [
    "knn_l2_within_key",
    "knn_l2_global",
    "knn_cosine_top2",
    "success_at_k",
    "success_rollup",
    "hash_encode",
    "embed_once_fanout",
    "retrieve_passages",
    "fixed_chunks",
    "min_cost_segments",
    "diff_changed_lines",
    "traceback_extract",
    "locate_passage",
    "enclosing_span",
    "uncovered_lines",
    "code_chunks",
    "call_resolution",
    "reachability",
    "prompt_assembly",
    "rates_with_skips",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = get_session(master=f"local[{cpus}]", shuffle_partitions=int(cpus), driver_memory="16g")
    qs = registry.queries()
    # warm up the JVM and the Python workers once, outside the timings
    qs["fixed_chunks"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        t0 = time.time()
        qs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({
        "metric": "total_query_seconds",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(sf) if sf.replace(".", "").isdigit() else sf,
    }))


if __name__ == "__main__":
    main()
