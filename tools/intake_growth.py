"""Time and files of the intake's routing batches: does a batch cost the same late as early?

Usage: python tools/intake_growth.py [batches] [messages a batch]

Builds order messages over many batches (one in ten repeats an earlier uid),
runs the intake over them one landed file a batch, and prints the seconds of
every routing trigger, and at the end the live parts, their files and rows.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from pyspark.sql import functions as F  # noqa: E402

from parcelry import schemas  # noqa: E402
from parcelry.session import build_session  # noqa: E402
from parcelry.streaming.commits import CommitLog  # noqa: E402
from parcelry.streaming.intake import committed_outcomes, file_source, start_intake  # noqa: E402
from tests.helpers import order  # noqa: E402


def main() -> None:
    batches, size = int((sys.argv + ["50"])[1]), int((sys.argv + ["", "2000"])[2] if len(sys.argv) > 2 else 2000)
    spark = build_session("local[8]", shuffle_partitions=8)
    root = tempfile.mkdtemp(prefix="intake-growth-", dir=os.environ.get("TMPDIR", "/tmp"))
    text = json.dumps(order(order_uid="UID")).split("UID")
    n = spark.range(batches * size)
    b, i = F.expr(f"id div {size}"), F.col("id") % size
    uid = F.when((i % 10 == 0) & (b > 0), F.concat(F.lit("u"), (F.col("id") - size + 1).cast("string"))).otherwise(F.concat(F.lit("u"), F.col("id").cast("string")))
    ts = F.timestamp_seconds(F.lit(1_704_067_200) + F.col("id"))
    rows = n.select(
        F.lit(None).cast("binary").alias("key"), F.concat(F.lit(text[0]), uid, F.lit(text[1])).cast("binary").alias("value"),
        F.array(F.struct(F.lit(schemas.CREATION_HEADER).alias("key"), F.unix_millis(ts).cast("string").cast("binary").alias("value"))).alias("headers"),
        F.lit("orders").alias("topic"), F.lit(0).alias("partition"), F.col("id").alias("offset"), ts.alias("timestamp"))
    rows.repartitionByRange(batches, "offset").write.parquet(f"{root}/in")
    ck, out = f"{root}/checkpoint", f"{root}/out"
    intake = start_intake(file_source(spark, f"{root}/in", max_files=1), out, ck, available_now=True, max_files=1)
    print("landing:", [round(p.durationMs.get("triggerExecution", 0) / 1000, 1) for p in intake.landing.recentProgress], flush=True)
    seen = {}
    while intake.routing.isActive:
        intake.routing.awaitTermination(2)
        for p in intake.routing.recentProgress:
            if p.batchId not in seen:
                seen[p.batchId] = p.durationMs
                print(f"batch {p.batchId + 1}: {p.durationMs.get('triggerExecution', 0) / 1000:.1f} s", dict(p.durationMs) if p.batchId < 4 else "", flush=True)
    log = CommitLog(spark, out)
    m = log.latest()
    print({t: (len(m.of(t)), sum(p.files for p in m.of(t)), sum(p.rows for p in m.of(t))) for t in ("orders", "dead_letters", "outcomes")}, "parts, files, rows")
    print({r["status"]: r["count"] for r in committed_outcomes(spark, out).groupBy("status").count().collect()})
    spark.stop()


if __name__ == "__main__":
    main()
