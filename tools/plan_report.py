"""Summarise the physical plan of every registered query (markdown table).

Usage: python tools/plan_report.py [sf_dir] > PLANS.md

Per query: shuffles (Exchange), broadcasts, join strategies, aggregate
operators, windows, generators, and the filters pushed into the scans.
Plans are taken before execution (AQE may still re-plan at runtime).
"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from parcelry.plans.catalog import catalog  # noqa: E402
from parcelry.session import build_session  # noqa: E402


def summarise(plan: str) -> dict[str, str]:
    ops = {
        "shuffles": len(re.findall(r"Exchange hashpartitioning|Exchange rangepartitioning|Exchange SinglePartition|Exchange RoundRobinPartitioning", plan)),
        "broadcasts": len(re.findall(r"BroadcastExchange", plan)),
    }
    joins = sorted(set(re.findall(r"(BroadcastHashJoin|SortMergeJoin|ShuffledHashJoin|BroadcastNestedLoopJoin|CartesianProduct)\s*(?:\[[^\]]*\]\s*)?(\w+)?", plan)))
    aggs = sorted(set(re.findall(r"(HashAggregate|SortAggregate|ObjectHashAggregate)", plan)))
    other = sorted(set(re.findall(r"\b(Window|Generate|TakeOrderedAndProject|Expand)\b", plan)))
    pushed = sorted(set(f for f in re.findall(r"PushedFilters: \[([^\]]*)\]", plan) if f and "IsNotNull" not in f[:9] or (f and "," in f)))
    return {
        "shuffles": str(ops["shuffles"]),
        "broadcasts": str(ops["broadcasts"]),
        "joins": ", ".join(f"{j} {t}".strip() for j, t in joins) or "-",
        "aggregates": ", ".join(aggs) or "-",
        "other": ", ".join(other) or "-",
        "pushed filters": "; ".join(p[:80] for p in pushed) or "-",
    }


def main() -> None:
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session("local[8]", shuffle_partitions=8)
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # show the static plan
    cols = ["shuffles", "broadcasts", "joins", "aggregates", "other", "pushed filters"]
    print("# Physical plans (static, AQE off; generated by tools/plan_report.py)\n")
    print(f"Data: `{sf_dir}`.  Broadcasts come from size-checked sides only (nation/region, part under its row bound,")
    print("Spark's own estimate for small dimension tables, latest-N keys).\n")
    print("| query | " + " | ".join(cols) + " |")
    print("| --- | " + " | ".join("---" for _ in cols) + " |")
    for name, fn in catalog().items():
        plan = fn(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
        s = summarise(plan)
        print(f"| {name} | " + " | ".join(s[c] for c in cols) + " |")
    spark.stop()


if __name__ == "__main__":
    main()
