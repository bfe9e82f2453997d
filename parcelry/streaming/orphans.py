"""Referential audit on streams (K6): child rows whose order never came.

A left outer stream-stream join on the uid within a span of time.  A child
row waits in state until the watermark says that no order of its span can
still arrive, and then comes out as an orphan; state is bounded by the span
and the watermark's delay, not by the history.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from parcelry.session import checkpoint_dir, ensure_conf
from parcelry.streaming.uniqueness import rocksdb

WITHIN, DELAY = "36 hours", "1 day"


def orphan_stream(children: DataFrame, orders: DataFrame, within: str = WITHIN, delay: str = DELAY) -> DataFrame:
    """Rows of ``children`` (``order_uid``, ``ts``, more) with no row of ``orders``
    (``order_uid``, ``ts``) of that uid within ``within`` of them, in append mode."""
    c = children.withWatermark("ts", delay)
    o = orders.select(F.col("order_uid").alias("_uid"), F.col("ts").alias("_ts")).withWatermark("_ts", delay)
    near = F.expr(f"_ts >= ts - interval {within} and _ts <= ts + interval {within}")
    joined = c.join(o, (F.col("order_uid") == F.col("_uid")) & near, "leftOuter")
    return joined.filter(F.col("_uid").isNull()).select(*children.columns)


def streamed_orphans(spark: SparkSession, children_path: str, orders_path: str, within: str = WITHIN, delay: str = DELAY) -> DataFrame:
    """Run ``orphan_stream`` over two folders to the end of what is there, and return what came out:
    the orphans whose span ended before the last event less the watermark's delay."""
    ensure_conf(spark)
    root = f"{checkpoint_dir(spark).rstrip('/')}/orphans-{uuid.uuid4().hex}"

    def stream(path: str) -> DataFrame:
        return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)

    found = orphan_stream(stream(children_path), stream(orders_path), within, delay)
    with rocksdb(spark):
        q = (found.writeStream.outputMode("append").format("parquet").option("path", f"{root}/out")
             .option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start())
        q.awaitTermination()
    return spark.read.schema(found.schema).parquet(f"{root}/out")
