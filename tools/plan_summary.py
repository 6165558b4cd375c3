"""Print the physical-operator mix of registered queries (plan before adaptive re-planning).

Usage: python tools/plan_summary.py [sf_dir] [key ...]
"""

from __future__ import annotations

import os
import sys
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from spindle.plans.catalog import REGISTRY  # noqa: E402
from spindle.session import local_session  # noqa: E402

SHOWN = (
    "Exchange", "BroadcastExchange", "BroadcastHashJoin", "SortMergeJoin", "ShuffledHashJoin",
    "BroadcastNestedLoopJoin", "CartesianProduct", "HashAggregate", "SortAggregate", "ObjectHashAggregate",
    "Window", "WindowGroupLimit", "TakeOrderedAndProject", "Generate", "Sort", "InMemoryTableScan",
)


def plan_nodes(df) -> Counter:
    names: list[str] = []

    def walk(n):
        nm = n.nodeName()
        if nm == "AdaptiveSparkPlan":
            return walk(n.initialPlan())
        names.append(nm)
        if nm == "InMemoryTableScan":  # cached side tables: their own plans are not part of this one
            return
        it = n.children().iterator()
        while it.hasNext():
            walk(it.next())

    walk(df._jdf.queryExecution().executedPlan())
    return Counter(names)


def main() -> None:
    args = sys.argv[1:]
    sf_dir = "/root/testdata/sf0.001"
    if args and args[0].startswith("/"):
        sf_dir, args = args[0], args[1:]
    spark = local_session(2)
    for k in args or list(REGISTRY):
        spark.catalog.clearCache()
        c = plan_nodes(REGISTRY[k](spark, sf_dir))
        print(f"{k:26s} " + " ".join(f"{n}={c[n]}" for n in SHOWN if c[n]))
    spark.stop()


if __name__ == "__main__":
    main()
