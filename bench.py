"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query's full result is computed with the ``noop`` sink (every row is
produced, nothing is collected to the driver).  An untimed warm-up at
sf0.001 precedes the timed runs.  Prints ONE JSON line:
{"metric": ..., "value": total_seconds, "unit": "sec", "queries": {...}, "sf": ...}
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from parcelry.plans.catalog import catalog  # noqa: E402
from parcelry.session import build_session  # noqa: E402
from parcelry.sources.messages import message_table  # noqa: E402

HEADLINE = [
    "order_documents",            # flagship: 4-way re-assembly with ordered item aggregate
    "order_documents_from_tables",  # literal J1/J2/J3a over the normalised tables
    "order_item_flat",
    "latest_orders",
    "message_outcomes",           # decode + rules + uniqueness routing of every message
    "dead_letters_by_reason",
    "request_rate_5m",
    "latency_histogram",
    "p95_by_group",
    "counter_increase_with_resets",
    "trailing_5m_count",
    "consumer_lag",
    "outcomes_by_status",
    "dead_letter_messages",
    "decode_verdicts",
    "validation_verdicts",
    "duplicate_orders",
    "hot_orders",
    "items_rows",
    "orphan_items",
    "gauge_ratio",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    extra = {"spark.driver.memory": os.environ["BENCH_DRIVER_MEMORY"]} if os.environ.get("BENCH_DRIVER_MEMORY") else None
    spark = build_session(f"local[{cpus}]", shuffle_partitions=int(cpus) * 2, extra=extra)
    cat = catalog()
    # Untimed warm-up on the smallest data set (JVM class loading and JIT),
    # so the first timed query is not charged for process start-up.
    warm = os.environ.get("BENCH_WARMUP_DIR", "/root/testdata/sf0.001")
    if os.path.isdir(warm):
        for name in ("order_documents", "message_outcomes"):
            cat[name](spark, warm).write.format("noop").mode("overwrite").save()
    # The message table is written before the timed runs, so no query pays for
    # it and the times do not depend on the order of the queries.
    message_table(spark, sf_dir)
    times: dict[str, float] = {}
    for name in names:
        t0 = time.time()
        cat[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "headline_queries_total_seconds",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(m.group(1)) if m else sf_dir,
        "cpus": int(cpus),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
