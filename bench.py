"""Benchmark: the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query runs to completion through the ``noop`` sink (the whole plan executes, nothing is
collected). Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from spindle.plans.catalog import REGISTRY  # noqa: E402
from spindle.session import local_session  # noqa: E402

HEADLINE = [
    "keyword_frequency",
    "label_scores",
    "label_scores_proto",
    "topic_terms",
    "topic_assign_text",
    "topic_assign",
    "enrich_documents",
    "upsert_results",
    "latest_status",
    "keyphrase_scores",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    keys = sys.argv[1:] or HEADLINE
    spark = local_session(cores=cpus, shuffle_partitions=int(cpus) * 2, app="spindle-bench")
    # warm-up on the smallest fixture: JIT, class loading and code generation of the same plans,
    # so that no headline query is charged for them
    warm_dir = os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001")
    if not os.path.isdir(warm_dir):
        warm_dir = sf_dir
    for k in keys:
        REGISTRY[k](spark, warm_dir).write.format("noop").mode("overwrite").save()
        spark.catalog.clearCache()
    times = {}
    for k in keys:
        t0 = time.time()
        REGISTRY[k](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[k] = round(time.time() - t0, 3)
        spark.catalog.clearCache()
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(sf) if sf.replace(".", "").isdigit() else sf,
                "cpus": int(cpus),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
