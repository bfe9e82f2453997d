"""Operational logs derived from the ``events`` table (FIXTURES.md B3).

The original service exports counters, gauges and histograms; the exact,
Spark-friendly input is the raw event each of them counts.  These builders
give those raw logs (and sampled series) from the driver's event table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from parcelry.sources.tables import load

# Event-type mapping of the fixtures.
VALID_TYPES = ["view", "click", "purchase"]
OFFSET_PARTITIONS = 8
TOPIC = "orders"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "events")


def outcome_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, ts, status, reason) - one consumer outcome per event."""
    return outcome_rows(_events(spark, sf_dir))


def outcome_rows(e: DataFrame) -> DataFrame:
    """The outcome log of an event frame (batch or stream)."""
    t = F.col("event_type")
    status = F.when(t.isin(*VALID_TYPES), "valid").when(t == "signup", "invalid").when(t == "error", "error")
    reason = F.when(t == "signup", "invalid_order").when(t == "error", "unhandled_error")
    return e.select("event_id", "ts", status.alias("status"), reason.alias("reason"))


def request_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, ts, method, path, code, seconds) - one HTTP request per event."""
    e = _events(spark, sf_dir)
    t = F.col("event_type")
    path = F.when(t == "signup", F.lit("/home")).otherwise(F.concat(F.lit("/orders/"), F.col("user_id").cast("string")))
    return e.select("event_id", "ts", F.lit("GET").alias("method"), path.alias("path"),
                    F.when(t == "error", 500).otherwise(200).alias("code"),
                    (F.col("value") / 1000).alias("seconds"))


def lookup_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, ts, hit) - cache lookups; every third is a miss."""
    return _events(spark, sf_dir).select("event_id", "ts", (F.col("event_id") % 3 != 0).alias("hit"))


def access_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(key, ts) - key accesses."""
    return _events(spark, sf_dir).select(F.col("user_id").alias("key"), "ts")


def counter_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series, sample_id, ts, value) - a counter per user with resets (``event_id % 500``)."""
    return _events(spark, sf_dir).select(F.col("user_id").alias("series"), F.col("event_id").alias("sample_id"), "ts",
                                         (F.col("event_id") % 500).cast("double").alias("value"))


def transmit_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series, sample_id, ts, value) - a second counter per user with resets (``event_id % 700``)."""
    return _events(spark, sf_dir).select(F.col("user_id").alias("series"), F.col("event_id").alias("sample_id"), "ts",
                                         (F.col("event_id") % 700).cast("double").alias("value"))


# How much faster than the events the scrapes run, so that a range holds several.
SCRAPE_SPEEDUP = 100
SCRAPE_START_US = 1_704_067_200_000_000  # 2024-01-01T00:00:00Z
INSTANCES = 8


def scraped_counter(spark: SparkSession, sf_dir: str, modulus: int) -> DataFrame:
    """(series, sample_id, ts, value) - a counter per instance (``user_id % 8``) with resets
    (``event_id % modulus``), scraped at the events' times, run a hundred times as fast."""
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    fast = F.lit(SCRAPE_START_US) + F.floor((us - SCRAPE_START_US) / SCRAPE_SPEEDUP)
    return _events(spark, sf_dir).select((F.col("user_id") % INSTANCES).alias("series"), F.col("event_id").alias("sample_id"),
                                         F.timestamp_micros(fast.cast("long")).alias("ts"), (F.col("event_id") % modulus).cast("double").alias("value"))


def gauge_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series, sample_id, ts, mountpoint, value) - free space per user: ``round(value)``."""
    mount = F.element_at(F.array(F.lit("/"), F.lit("/data"), F.lit("/boot")), (F.col("user_id") % 3 + 1).cast("int"))
    return _events(spark, sf_dir).select(F.col("user_id").alias("series"), F.col("event_id").alias("sample_id"), "ts",
                                         mount.alias("mountpoint"), F.round("value").alias("value"))


def capacity_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series, sample_id, capacity) - the size gauge of the same scrapes: free space plus what is used."""
    return _events(spark, sf_dir).select(F.col("user_id").alias("series"), F.col("event_id").alias("sample_id"),
                                         (F.round("value") + F.col("event_id") % 4000).alias("capacity"))


def load_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series, ts, load1, load5, load15) - three load gauges per user."""
    v = F.col("value")
    return _events(spark, sf_dir).select(F.col("user_id").alias("series"), "ts", F.round(v / 1000, 3).alias("load1"),
                                         F.round(v / 2000, 3).alias("load5"), F.round(v / 4000, 3).alias("load15"))


def attempt_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, attempt, transient) - each event takes ``event_id % 3`` transient failures, then one last attempt."""
    e = _events(spark, sf_dir).select("event_id", (F.col("event_id") % 3).cast("int").alias("fails"))
    x = e.select("event_id", "fails", F.explode(F.sequence(F.lit(0), F.col("fails"))).alias("attempt"))
    return x.select("event_id", "attempt", (F.col("attempt") < F.col("fails")).alias("transient"))


def cache_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(operation, seconds) - cache calls; every fourth is a set."""
    return _events(spark, sf_dir).select(F.when(F.col("event_id") % 4 == 0, "set").otherwise("get").alias("operation"),
                                         (F.col("value") / 10000).alias("seconds"))


def db_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(operation, seconds) - database calls by kind."""
    return _events(spark, sf_dir).select(F.col("event_type").alias("operation"), (F.col("value") / 500).alias("seconds"))


def status_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(series, sample_id, ts, value) - a 0/1 up gauge per user, null every 7th event."""
    e = _events(spark, sf_dir)
    v = F.when(F.col("event_id") % 7 != 0, (F.col("event_id") % 2).cast("double"))
    return e.select(F.col("user_id").alias("series"), F.col("event_id").alias("sample_id"), "ts", v.alias("value"))


def partition_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(topic, partition, low, high, committed) per partition ``user_id % 8``;
    committed = last purchase event id, never committed (-1) on partition 0.
    One aggregate; combines map-side."""
    e = _events(spark, sf_dir)
    p = (F.col("user_id") % OFFSET_PARTITIONS).cast("int")
    g = e.groupBy(p.alias("partition")).agg(
        F.min("event_id").alias("low"), (F.max("event_id") + 1).alias("high"),
        F.max(F.when(F.col("event_type") == "purchase", F.col("event_id"))).alias("_c"))
    committed = F.when(F.col("partition") == 0, F.lit(-1)).otherwise(F.coalesce(F.col("_c"), F.lit(-1)))
    return g.select(F.lit(TOPIC).alias("topic"), "partition", "low", "high", committed.cast("long").alias("committed"))


def page_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, url) from the pages table."""
    return load(spark, sf_dir, "pages").select("page_id", "url")
