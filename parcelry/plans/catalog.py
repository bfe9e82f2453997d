"""The query catalog: one builder per operator, ``(spark, sf_dir) -> DataFrame``.

Every builder reads the driver tables (or data Spark derives from them) in
full; nothing is subset, sampled or capped except where a limit *is* the
feature (latest-N, recently-used-N).
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from parcelry.functions.decode import creation_time, creation_time_ms, decode_messages
from parcelry.functions.formats import timestamp_text
from parcelry.functions.rules import item_violations
from parcelry.operators import documents as doc
from parcelry.operators import normalize as norm
from parcelry.operators import outcomes as out
from parcelry.operators import ranges
from parcelry.operators import series as ser
from parcelry.plans import files
from parcelry.plans.derived import derived
from parcelry.plans.guards import bind, estimated_bytes, written
from parcelry.session import checkpoint_dir
from parcelry.sources import oplogs
from parcelry.sources.messages import message_path, message_table, order_messages, source_paths, stamped
from parcelry.sources.tables import base_fields, base_parts, header_fields, header_parts, item_lines, line_parts, load, order_base, order_headers, order_uid
from parcelry.streaming.commits import ORDERS, CommitLog
from parcelry.streaming.compaction import compact, write_sorted
from parcelry.streaming.intake import committed_outcomes, file_source, start_intake, streamed_outcome_rate
from parcelry.streaming.orphans import streamed_orphans
from parcelry.streaming.reads import latest_stored_orders, orders_by_uid

Builder = Callable[[SparkSession, str], DataFrame]

# Limits of the snapshot queries, set so that they drop some of the test rows
# (the service's own defaults are in operators.documents).
HOT_ENTRY_BYTES = 1_100
RECENT_KEYS = 100
LOOKUP_KEYS = 100


# ---------------------------------------------------------------- documents

def order_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doc.order_documents(doc.order_facts(spark, sf_dir))


def _text_times(df: DataFrame, cols=("date_created", "created_at", "updated_at")) -> DataFrame:
    return df.select(*[timestamp_text(F.col(c)).alias(c) if c in cols else F.col(c) for c in df.columns])


def _items_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = line_parts(spark, sf_dir).withColumn("order_uid", F.concat(F.lit("ord"), "order_key"))
    return doc.item_rows(lines)


def orders_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _text_times(norm.orders_rows(order_base(spark, sf_dir)))


def deliveries_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return norm.deliveries_rows(order_headers(spark, sf_dir))


def payments_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return norm.payments_rows(order_base(spark, sf_dir))


def items_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _items_table(spark, sf_dir)


def order_documents_from_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J1, J2, J3a literally: the four normalised tables joined on order_uid."""
    base = order_base(spark, sf_dir)
    return doc.assemble_documents(norm.orders_rows(base), norm.deliveries_rows(order_headers(spark, sf_dir)),
                                  norm.payments_rows(base), _items_table(spark, sf_dir))


STORE_MODULES = ("parcelry.operators.documents", "parcelry.operators.normalize", "parcelry.sources.tables", "parcelry.functions.formats",
                 "parcelry.schemas", "parcelry.plans.layout", "parcelry.plans.catalog", "parcelry.streaming.commits", "parcelry.streaming.compaction")
BUCKETS_PER_GB = 128  # a bucket of items, made up, is sorted in one task: some 150 MB
STORE_BATCHES = 6
STORE_FILE_BYTES = 8 << 20  # of compressed source columns; a task sorts them by uid


def _store_sources(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    base = base_parts(spark, sf_dir)
    found = {"orders": base, "deliveries": header_parts(spark, sf_dir), "payments": base, "items": line_parts(spark, sf_dir)}
    return {name: df.withColumn("order_uid", order_uid(F.col("order_key"))) for name, df in found.items()}


STORE_ROWS = {
    "orders": lambda df: norm.orders_rows(df.select(*base_fields())),
    "deliveries": lambda df: norm.deliveries_rows(df.select(*header_fields())),
    "payments": lambda df: norm.payments_rows(df.select(*base_fields())),
    "items": doc.item_rows,
}


def bucketed_tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The four tables, stored once in buckets by order (8 at least, more with the bytes of the line items)."""
    def build(root: str) -> None:
        size = estimated_bytes(load(spark, sf_dir, "lineitem")) or 0
        norm.store_tables(_store_sources(spark, sf_dir), STORE_ROWS, root, min(50_000, max(8, size * BUCKETS_PER_GB >> 30)))

    return norm.open_tables(spark, derived(spark, "bucketed", source_paths(sf_dir), STORE_MODULES, build))


def order_documents_bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J1, J2, J3a over bucketed tables: no exchange."""
    t = bucketed_tables(spark, sf_dir)
    return doc.assemble_documents(t["orders"], t["deliveries"], t["payments"], t["items"], colocated=True)


def not_null_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K5: every NOT NULL column of the four stored tables."""
    return norm.not_null_audits(bucketed_tables(spark, sf_dir))


def _stored_rows(parts: DataFrame, batch: int) -> DataFrame:
    """The store's rows of ``order_parts``: every column of the store, those that the tables lack null."""
    facts = doc.order_fields(parts)
    have = set(facts.columns)
    cols = [F.col(f.name) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name) for f in norm.STORE_SCHEMA.fields if f.name != norm.BATCH_COL]
    return facts.select(*cols, F.lit(batch).cast("long").alias(norm.BATCH_COL))


def order_store(spark: SparkSession, sf_dir: str) -> str:
    """A committed store of all orders: batches in the order of their times, then compacted.

    The orders' source columns are written once for the batches and leave the
    disk before the compaction; the parts that it merged leave it after.
    """
    def build(root: str) -> None:
        log = CommitLog(spark, root)
        parts = doc.order_parts(spark, sf_dir).withColumn("order_uid", order_uid(F.col("order_key")))
        facts = f"{root}/_facts"
        parts = written(parts.withColumn("_us", F.unix_micros("o_orderdate")), "facts", facts)
        cuts, total = parts.select(F.percentile_approx("_us", [i / STORE_BATCHES for i in range(1, STORE_BATCHES)], 1000), F.count(F.lit(1))).first()
        size = estimated_bytes(parts) or 0
        for i, (low, high) in enumerate(zip([None, *(cuts or [])], [*(cuts or []), None])):
            us = F.col("_us")
            mine = (F.lit(True) if low is None else us > low) & (F.lit(True) if high is None else us <= high)
            batch = parts.filter(mine)
            rows = batch.count()
            n_files = max(4, math.ceil(size * rows / max(total, 1) / STORE_FILE_BYTES))
            part = write_sorted(log, batch, ORDERS, n_files, rows, lambda df, i=i: _stored_rows(df, i))
            log.commit_batch("build", i, [part] if part else [])
        files.delete(spark, facts)
        compact(log, fan_in=STORE_BATCHES // 2)
        log.vacuum(older_than_s=0, versions=1)  # nobody reads a store that is being built

    return derived(spark, "order-store", source_paths(sf_dir), STORE_MODULES, build)


def order_lookup_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """q: documents of the most accessed orders, read from the store by key (a bounded list: the lookup's own limit)."""
    keys = counts_of_access(spark, sf_dir).limit(LOOKUP_KEYS).collect()
    return doc.order_documents(orders_by_uid(spark, order_store(spark, sf_dir), [f"ord{r['key']}" for r in keys]))


def counts_of_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = ser.counts_by(oplogs.access_log(spark, sf_dir), "key")
    return n.orderBy(F.col("n").desc(), "key").select("key")


def latest_orders_stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W1 on the store: newest files only."""
    top = latest_stored_orders(spark, order_store(spark, sf_dir), doc.PRELOAD_SIZE)
    rank = F.row_number().over(Window.orderBy(F.col("updated_at").desc_nulls_first(), F.col("order_uid")))  # PRELOAD_SIZE rows
    return top.select(rank.alias("rank"), "order_uid", doc.document_json(top).alias("document"))


def streamed_message_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T1, T2, S4 as a stream: the message table through the intake's two queries, read back from its commits."""
    root = f"{checkpoint_dir(spark).rstrip('/')}/intake-{uuid.uuid4().hex}"
    start_intake(file_source(spark, message_path(spark, sf_dir)), f"{root}/out", f"{root}/checkpoint", available_now=True).awaitTermination()
    return committed_outcomes(spark, f"{root}/out").select("topic", "partition", "offset", "order_uid", "status", "reason")


def items_per_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = doc.items_per_order(line_parts(spark, sf_dir))
    return lists.select(F.concat(F.lit("ord"), F.col("order_key")).alias("order_uid"),
                        F.size("items").alias("n_items"), F.to_json("items").alias("items_json"))


def order_by_uid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batch point lookup: the documents of every order key the access log asks for."""
    keys = load(spark, sf_dir, "events").select(F.col("user_id").alias("order_key"))
    return doc.order_documents_for_keys(spark, sf_dir, keys)


def order_item_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doc.order_item_flat_lines(header_parts(spark, sf_dir), line_parts(spark, sf_dir))


def order_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doc.order_summary(doc.order_facts(spark, sf_dir))


def order_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doc.order_sizes(doc.order_facts(spark, sf_dir))


def latest_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doc.latest_orders(spark, sf_dir, doc.PRELOAD_SIZE)


def hot_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doc.hot_orders(spark, sf_dir, doc.PRELOAD_SIZE, HOT_ENTRY_BYTES)


# Fixed migration time used when replaying the additive migration offline.
MIGRATION_TS = "2024-01-01 00:00:00"


def orders_with_audit_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pre-migration order rows (no audit columns) after the up-migration."""
    old = norm.without_audit_columns(norm.orders_rows(order_base(spark, sf_dir)))
    return _text_times(norm.with_audit_columns(old, F.to_timestamp(F.lit(MIGRATION_TS))))


def _stored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uids of the orders that the intake stores: one row per uid."""
    return _decided(spark, sf_dir).filter(F.col("status") == out.VALID).select("order_uid")


def orphan_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Item rows whose order is not in the store (anti-joined before items are numbered)."""
    lines = line_parts(spark, sf_dir).withColumn("order_uid", F.concat(F.lit("ord"), "order_key"))
    left = norm.orphan_children(lines, _stored(spark, sf_dir))
    return doc.item_rows(left).select("order_uid", "item_pos", "chrt_id")


def orphan_payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return norm.orphan_children(norm.payments_rows(order_base(spark, sf_dir)), _stored(spark, sf_dir)).select("order_uid", "amount")


def streaming_orphan_payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K6 on the stream: payments whose order is not stored, out once the watermark has passed their span."""
    root = f"{checkpoint_dir(spark).rstrip('/')}/orphan-inputs-{uuid.uuid4().hex}"
    base = order_base(spark, sf_dir)
    at = base.select("order_uid", F.col("date_created").cast("timestamp").alias("ts"), F.col("payment.amount").alias("amount"))
    at.write.parquet(f"{root}/payments")
    at.join(_stored(spark, sf_dir), "order_uid", "left_semi").select("order_uid", "ts").write.parquet(f"{root}/orders")
    return streamed_orphans(spark, f"{root}/payments", f"{root}/orders").select("order_uid", "amount")


def orphan_deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return norm.orphan_children(norm.deliveries_rows(order_headers(spark, sf_dir)), _stored(spark, sf_dir)).select("order_uid", "name")


def orphan_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders without a stored delivery row (J1 drops them)."""
    return norm.orders_missing(norm.orders_rows(order_base(spark, sf_dir)), _stored(spark, sf_dir)).select("order_uid")


def not_null_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K5: nulls per required column of the flat view (orders without items have null item columns)."""
    flat = doc.order_item_flat_lines(header_parts(spark, sf_dir), line_parts(spark, sf_dir))
    return norm.null_audit(flat, ["order_uid", "delivery_name", "amount", "chrt_id", "rid", "brand"])


def hot_order_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders and items of the preload batch."""
    top = doc.latest_order_keys(order_headers(spark, sf_dir), doc.PRELOAD_SIZE).select("order_key")
    items = item_lines(spark, sf_dir).join(F.broadcast(top), "order_key", "left_semi")  # PRELOAD_SIZE rows at most
    both = top.select(F.lit(1).alias("o"), F.lit(0).alias("i")).unionAll(items.select(F.lit(0), F.lit(1)))
    return both.agg(F.coalesce(F.sum("o"), F.lit(0)).alias("n_orders"), F.coalesce(F.sum("i"), F.lit(0)).alias("n_items"))


# ---------------------------------------------------------------- messages

def synthetic_order_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = order_messages(spark, sf_dir)
    return m.select("topic", "partition", "offset", timestamp_text(F.col("timestamp")).alias("ts"),
                    creation_time_ms(F.col("headers")).alias("creation_ms"), F.hex("value").alias("value_hex"))


def decode_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = decode_messages(message_table(spark, sf_dir))
    return d.select("topic", "partition", "offset", "decode_ok", "decode_error")


def _checked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out.checked_messages(message_table(spark, sf_dir))


def validation_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _checked(spark, sf_dir).filter("decode_ok")
    return c.select("partition", "offset", "order_uid", (F.size("violations") == 0).alias("valid"),
                    F.array_join("violations", ",").alias("violations"))


def rule_violation_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _checked(spark, sf_dir).filter("decode_ok")
    return c.select(F.explode("violations").alias("rule")).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


def item_rule_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = decode_messages(message_table(spark, sf_dir))
    # bound: the explode's own filter would evaluate the rules again for every row
    c = bind(d, F.when(F.col("decode_ok"), F.flatten(item_violations(F.col("order")))).alias("all")).select("all")
    # an order counts once per rule: with the first of its items that breaks it
    x = c.select(F.posexplode("all").alias("i", "rule"), "all")
    x = x.select("rule", (F.array_position("all", F.col("rule")) == F.col("i") + 1).cast("long").alias("first"))
    return x.groupBy("rule").agg(
        F.count(F.lit(1)).alias("n_items"),
        F.sum("first").alias("n_orders"))


def storable_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _checked(spark, sf_dir).filter(F.col("decode_ok") & (F.size("violations") == 0))
    return c.select("partition", "offset", "order_uid", "order_error", "child_error")


def _decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes without payloads; the narrow checked frame is written once, so each message is decoded once."""
    return out.decide(_checked(spark, sf_dir), materialize=True)


def message_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decided(spark, sf_dir).select("topic", "partition", "offset", "order_uid", "status", "reason",
                                         "error_text", "dead_lettered")


def outcomes_by_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out.outcome_counts(_decided(spark, sf_dir))


def dead_letters_by_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out.dead_letter_counts(_decided(spark, sf_dir))


def dead_letter_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = out.dead_letters(out.attach(message_table(spark, sf_dir), _decided(spark, sf_dir).filter("dead_lettered")))
    last = F.element_at("headers", -1)
    return d.select("partition", "offset", "reason", F.size("headers").alias("n_headers"),
                    F.col("headers")[0]["key"].alias("first_header"), last["key"].alias("last_header"),
                    last["value"].cast("string").alias("dlq_reason"))


def duplicate_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out.duplicate_uids(_checked(spark, sf_dir))


def first_order_per_uid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return out.first_message_per_uid(_checked(spark, sf_dir))


def stamped_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S3: every order document published as a message stamped with its
    creation time (the order date here, so the output is deterministic)."""
    facts = doc.order_facts(spark, sf_dir)
    docs = facts.select("order_uid", doc.document_json(facts).alias("document"), "date_created")
    env = stamped(docs, F.col("document"), at=F.col("date_created"), keep=["order_uid"])
    h = F.col("headers")[0]
    return env.select("order_uid", h["key"].alias("header_key"), h["value"].cast("string").alias("header_value"),
                      F.octet_length("value").alias("value_bytes"))


def message_creation_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = order_messages(spark, sf_dir)
    h = F.col("headers")
    return m.select("partition", "offset", creation_time_ms(h).alias("created_ms"),
                    timestamp_text(creation_time(h)).alias("created_at"))


# ---------------------------------------------------------------- series

def _ts(df: DataFrame, *cols: str) -> DataFrame:
    return df.select(*[timestamp_text(F.col(c)).alias(c) if c in cols else F.col(c) for c in df.columns])


def _routed_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = oplogs.request_log(spark, sf_dir)
    return r.withColumn("path", ser.normalized_path(F.col("path")))


def normalized_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = oplogs.request_log(spark, sf_dir).select(F.lit("request").alias("source"), F.col("event_id").alias("id"), "path")
    p = oplogs.page_paths(spark, sf_dir).select(F.lit("page").alias("source"), F.col("page_id").alias("id"),
                                                ser.url_path(F.col("url")).alias("path"))
    u = r.unionByName(p)
    return u.select("source", "id", "path", ser.normalized_path(F.col("path")).alias("route"))


def path_order_uid(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = oplogs.request_log(spark, sf_dir)
    return r.select("event_id", "path", ser.path_order_uid(F.col("path")).alias("order_uid"))


def requests_by_route_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ser.requests_by_route(oplogs.request_log(spark, sf_dir))


def latency_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["method", "path"]
    return ser.histogram_rows(ser.histogram(_routed_requests(spark, sf_dir), "seconds", keys), keys)


def hit_miss_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ser.hit_miss_counts(oplogs.lookup_log(spark, sf_dir))


def transient_error_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = oplogs.attempt_log(spark, sf_dir)
    return a.agg(F.count(F.lit(1)).alias("attempts"), F.count_if("transient").alias("transient_errors"))


def message_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seconds from a message's creation header to its processing, for every message, failures included.

    The processing time is the message time plus a delay read off its
    coordinates (0 to 4.999 s), since test tables have no clock of their own.
    """
    m = message_table(spark, sf_dir)
    delay = (F.col("offset") * 4 + F.col("partition")) % 5000
    processed = F.timestamp_micros(F.unix_micros("timestamp") + delay * 1000)
    seconds = (F.unix_micros(processed) - creation_time_ms(F.col("headers")) * 1000) / 1e6
    return m.select("partition", "offset", F.round(seconds, 6).alias("latency_seconds"))


def _p95(log: DataFrame, keys: list[str], bounds: list[float]) -> DataFrame:
    h = ser.histogram(log, "seconds", keys, bounds)
    return h.select(*keys, F.round(ser.histogram_quantile(0.95, F.col("cum"), bounds), 6).alias("p95"))


def consumer_latency_p95(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _p95(message_latency(spark, sf_dir).withColumnRenamed("latency_seconds", "seconds"), ["partition"], ser.DEFAULT_BUCKETS)


def cache_latency_p95(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _p95(oplogs.cache_log(spark, sf_dir), ["operation"], ser.CACHE_BUCKETS)


def db_latency_p95(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _p95(oplogs.db_log(spark, sf_dir), ["operation"], ser.DB_BUCKETS)


def streaming_outcome_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T5: the outcome log as a file stream, sliding rates in append mode; windows come out once the watermark has passed them."""
    return streamed_outcome_rate(spark, f"{sf_dir.rstrip('/')}/events.parquet")


def request_rate_5m(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ts(ser.window_rate(_routed_requests(spark, sf_dir), "ts", ["method", "path", "code"]), "window_start")


def outcome_rate_5m(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ts(ser.window_rate(oplogs.outcome_log(spark, sf_dir), "ts", ["status"]), "window_start")


def dead_letter_rate_5m(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = oplogs.outcome_log(spark, sf_dir).filter(F.col("reason").isNotNull())
    return _ts(ser.window_rate(o, "ts", ["reason"]), "window_start")


def hit_miss_rate_5m(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = oplogs.lookup_log(spark, sf_dir).withColumn("result", F.when(F.col("hit"), "hit").otherwise("miss"))
    return _ts(ser.window_rate(h, "ts", ["result"]), "window_start")


def error_rate_5m(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = oplogs.outcome_log(spark, sf_dir).filter(F.col("status") == "error")
    return _ts(ser.window_rate(o, "ts", []), "window_start")


def p95_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = ser.histogram(_routed_requests(spark, sf_dir), "seconds", ["path"])
    return h.select("path", F.round(ser.histogram_quantile(0.95, F.col("cum")), 6).alias("p95"))


def histogram_quantile_95(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["method", "path", "code"]
    h = ser.histogram(_routed_requests(spark, sf_dir), "seconds", keys)
    return h.select(*keys, F.round(ser.histogram_quantile(0.95, F.col("cum")), 6).alias("p95"))


def consumer_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ser.consumer_lag(oplogs.partition_offsets(spark, sf_dir))


def latest_gauge_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = ser.latest_non_null(oplogs.status_samples(spark, sf_dir))
    return _ts(g.select("series", "value", ser.status_text(F.col("value")).alias("status"), "ts"), "ts")


def _gauge_pct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """100 * (1 - free / size), two gauges of the same scrape joined on (series, sample)."""
    g, cap = oplogs.gauge_samples(spark, sf_dir), oplogs.capacity_samples(spark, sf_dir)
    j = g.join(cap, ["series", "sample_id"], "inner")
    pct = F.round(F.lit(100.0) * (F.lit(1.0) - F.try_divide(F.col("value"), F.col("capacity"))), 6)
    return j.select("series", "ts", "mountpoint", pct.alias("pct"))


def disk_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D3: D2 of the root mount only."""
    return _ts(_gauge_pct(spark, sf_dir).filter(F.col("mountpoint") == "/").drop("mountpoint"), "ts")


def load_averages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ts(oplogs.load_samples(spark, sf_dir), "ts")


def gauge_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ts(_gauge_pct(spark, sf_dir).drop("mountpoint"), "ts")


def gauge_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _gauge_pct(spark, sf_dir).drop("mountpoint")
    return _ts(g.withColumn("band", ser.gauge_band(F.col("pct"))), "ts")


def counter_increase_with_resets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ts(ser.counter_increase(oplogs.counter_samples(spark, sf_dir)), "window_start")


def network_transmit_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rate_by_instance(oplogs.transmit_samples(spark, sf_dir))


def counter_rate_by_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rate_by_instance(oplogs.counter_samples(spark, sf_dir))


def _rate_by_instance(samples: DataFrame) -> DataFrame:
    inc = ser.counter_increase(samples)
    g = inc.groupBy((F.col("series") % 8).alias("instance"), "window_start").agg(
        F.round(F.sum("increase") / ser.RANGE_SECONDS, 6).alias("rate"))
    return _ts(g, "window_start")


def irate_by_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = ser.counter_irate(oplogs.counter_samples(spark, sf_dir))
    g = r.groupBy((F.col("series") % 8).alias("instance"), "window_start").agg(
        F.round(F.lit(100.0) - F.avg("irate") * 100, 6).alias("cpu_pct"))
    return _ts(g, "window_start")


def _ranges(spark: SparkSession, sf_dir: str, modulus: int) -> DataFrame:
    return _ts(ranges.range_vectors(oplogs.scraped_counter(spark, sf_dir, modulus)), "at")


def counter_increase_5m(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``increase(x[5m])`` at every minute, with the raw increase between samples."""
    g = _ranges(spark, sf_dir, 500)
    return g.select("series", "at", "n_samples", F.round("raw_increase", 6).alias("raw_increase"), F.round("increase", 6).alias("increase"))


def network_receive_rate_5m(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``sum(rate(x[5m])) by (device)``; four devices of two instances."""
    return _rate_by_device(spark, sf_dir, 500)


def network_transmit_rate_5m(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As D4, on the second counter."""
    return _rate_by_device(spark, sf_dir, 700)


def _rate_by_device(spark: SparkSession, sf_dir: str, modulus: int) -> DataFrame:
    g = _ranges(spark, sf_dir, modulus).filter(F.col("rate").isNotNull())
    return g.groupBy((F.col("series") % 4).alias("device"), "at").agg(F.round(F.sum("rate"), 6).alias("rate"))


def cpu_usage_5m(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``100 - avg by (instance)(irate(idle[5m])) * 100``; two cores an instance."""
    g = _ranges(spark, sf_dir, 500).filter(F.col("irate").isNotNull())
    return g.groupBy((F.col("series") % 4).alias("instance"), "at").agg(F.round(F.lit(100.0) - F.avg("irate") * 100, 6).alias("cpu_pct"))


def trailing_5m_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = load(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("key"), "ts")
    return ser.trailing_count(x, "key", "ts").select("event_id", "key", "n_trailing")


def recently_used_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ts(ser.recently_used(oplogs.access_log(spark, sf_dir), RECENT_KEYS), "last_ts")


def catalog() -> dict[str, Builder]:
    return {
        "order_documents": order_documents,
        "orders_rows": orders_rows,
        "deliveries_rows": deliveries_rows,
        "payments_rows": payments_rows,
        "items_rows": items_rows,
        "order_documents_from_tables": order_documents_from_tables,
        "items_per_order": items_per_order,
        "order_by_uid": order_by_uid,
        "order_item_flat": order_item_flat,
        "order_summary": order_summary,
        "order_sizes": order_sizes,
        "latest_orders": latest_orders,
        "hot_orders": hot_orders,
        "orders_with_audit_columns": orders_with_audit_columns,
        "orphan_items": orphan_items,
        "orphan_orders": orphan_orders,
        "synthetic_order_messages": synthetic_order_messages,
        "decode_verdicts": decode_verdicts,
        "validation_verdicts": validation_verdicts,
        "rule_violation_counts": rule_violation_counts,
        "item_rule_failures": item_rule_failures,
        "storable_verdicts": storable_verdicts,
        "message_outcomes": message_outcomes,
        "outcomes_by_status": outcomes_by_status,
        "dead_letters_by_reason": dead_letters_by_reason,
        "dead_letter_messages": dead_letter_messages,
        "duplicate_orders": duplicate_orders,
        "first_order_per_uid": first_order_per_uid,
        "message_creation_time": message_creation_time,
        "stamped_messages": stamped_messages,
        "normalized_paths": normalized_paths,
        "path_order_uid": path_order_uid,
        "requests_by_route_code": requests_by_route_code,
        "latency_histogram": latency_histogram,
        "hit_miss_counts": hit_miss_counts,
        "transient_error_counts": transient_error_counts,
        "request_rate_5m": request_rate_5m,
        "outcome_rate_5m": outcome_rate_5m,
        "dead_letter_rate_5m": dead_letter_rate_5m,
        "hit_miss_rate_5m": hit_miss_rate_5m,
        "error_rate_5m": error_rate_5m,
        "p95_by_group": p95_by_group,
        "histogram_quantile_95": histogram_quantile_95,
        "consumer_lag": consumer_lag,
        "latest_gauge_status": latest_gauge_status,
        "gauge_ratio": gauge_ratio,
        "gauge_bands": gauge_bands,
        "counter_increase_with_resets": counter_increase_with_resets,
        "counter_rate_by_series": counter_rate_by_series,
        "irate_by_series": irate_by_series,
        "trailing_5m_count": trailing_5m_count,
        "orphan_payments": orphan_payments,
        "orphan_deliveries": orphan_deliveries,
        "not_null_audit": not_null_audit,
        "hot_order_items": hot_order_items,
        "message_latency": message_latency,
        "consumer_latency_p95": consumer_latency_p95,
        "cache_latency_p95": cache_latency_p95,
        "db_latency_p95": db_latency_p95,
        "network_transmit_rate": network_transmit_rate,
        "disk_usage": disk_usage,
        "load_averages": load_averages,
        "streaming_outcome_rate": streaming_outcome_rate,
        "recently_used_keys": recently_used_keys,
        "order_documents_bucketed": order_documents_bucketed,
        "not_null_columns": not_null_columns,
        "order_lookup_stored": order_lookup_stored,
        "latest_orders_stored": latest_orders_stored,
        "streamed_message_outcomes": streamed_message_outcomes,
        "streaming_orphan_payments": streaming_orphan_payments,
        "counter_increase_5m": counter_increase_5m,
        "network_receive_rate_5m": network_receive_rate_5m,
        "network_transmit_rate_5m": network_transmit_rate_5m,
        "cpu_usage_5m": cpu_usage_5m,
    }
