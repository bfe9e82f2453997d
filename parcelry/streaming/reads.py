"""Reads of committed orders that leave files out (q, W1).

Both reads choose files by the figures that the commit log keeps of every
part and file; the parts are filtered first, and only the file lists of those
that remain are opened.
"""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import DataFrame, SparkSession, functions as F

from parcelry.operators.documents import latest_order_keys
from parcelry.operators.normalize import STORE_SCHEMA
from parcelry.session import ensure_conf
from parcelry.streaming.commits import ORDERS, CommitLog, Manifest

MAX_LOOKUP_KEYS = 10_000


def _holds(low: str | None, high: str | None, keys: list[str]) -> bool:
    """Whether a sorted key lies in the range."""
    if low is None or high is None:
        return False
    i = bisect_left(keys, low)
    return i < len(keys) and keys[i] <= high


def lookup_files(log: CommitLog, uids: list[str], manifest: Manifest | None = None) -> list[str]:
    """The files whose uid range can hold one of ``uids`` (Spark's order of strings: by UTF-8 bytes)."""
    keys = sorted(set(uids), key=str.encode)
    by_bytes = [k.encode() for k in keys]
    within = lambda low, high: _holds(low and low.encode(), high and high.encode(), by_bytes)
    parts = [p for p in (manifest or log.latest()).of(ORDERS) if within(p.low, p.high)]
    return [f["path"] for p in parts for f in log.file_stats(p) if within(f["low"], f["high"])]


def orders_by_uid(spark: SparkSession, root: str, uids: list[str]) -> DataFrame:
    """The stored orders with these uids (q): range-skipped files, then row groups by statistics and Bloom filter."""
    ensure_conf(spark)
    if len(uids) > MAX_LOOKUP_KEYS:
        raise ValueError(f"{len(uids)} keys; above {MAX_LOOKUP_KEYS} join the stored orders with a table of keys")
    found = lookup_files(CommitLog(spark, root), uids)
    if not found:
        return spark.createDataFrame([], STORE_SCHEMA)
    return spark.read.schema(STORE_SCHEMA).parquet(*found).filter(F.col("order_uid").isin(sorted(set(uids))))


def latest_files(log: CommitLog, n: int) -> list[str]:
    """The files that can hold one of the ``n`` newest orders.

    Files come by their newest time until they hold ``n`` rows; the n-th time
    among those rows is a bound, and only files that reach it, or hold a row
    without a time, are read.
    """
    oldest = -(1 << 63)
    parts = log.latest().of(ORDERS)
    parts.sort(key=lambda p: oldest if p.newest is None else p.newest, reverse=True)
    rows, first, at = 0, [], 0
    # whole parts until they hold n rows: a part's newest time bounds its files' times
    while at < len(parts) and rows < n:
        rows += parts[at].rows
        first += log.file_stats(parts[at])
        at += 1
    if rows <= n and at == len(parts):
        return [f["path"] for f in first]
    first.sort(key=lambda f: oldest if f["newest"] is None else f["newest"], reverse=True)
    held, take = 0, []
    for f in first:
        if held >= n:
            break
        take.append(f["path"])
        held += f["rows"]
    times = log.spark.read.schema(STORE_SCHEMA).parquet(*take).select("order_uid", "updated_at")
    bound = latest_order_keys(times, n).select(F.unix_micros("updated_at").alias("t")).agg(F.min("t").alias("t"), F.bool_and(F.col("t").isNull()).alias("none")).first()
    floor = None if bound["none"] else bound["t"]

    def reaches(untimed: bool, newest: int | None) -> bool:
        return untimed or (floor is not None and newest is not None and newest >= floor)

    more = [f for p in parts[at:] if reaches(p.untimed, p.newest) for f in log.file_stats(p)]
    return [f["path"] for f in [*first, *more] if reaches(f["untimed"], f["newest"])]


def latest_stored_orders(spark: SparkSession, root: str, n: int) -> DataFrame:
    """W1 on the store: the ``n`` newest stored orders, ``updated_at`` DESC NULLS FIRST, uid as tie-break."""
    ensure_conf(spark)
    found = latest_files(CommitLog(spark, root), n) if n > 0 else []
    if not found:
        return spark.createDataFrame([], STORE_SCHEMA)
    return latest_order_keys(spark.read.schema(STORE_SCHEMA).parquet(*found), n)
