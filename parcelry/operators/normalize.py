"""Normalised tables as projections of the nested order row.

Spark has no multi-table transaction on files, and the original service's
promise is that all four tables of an order are written or none.  So the
nested order row is the only stored fact; ``orders``, ``deliveries``,
``payments`` and ``items`` are projections of it (views, not copies), and
``store_batch`` writes one partition per batch id, overwritten on replay.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from parcelry import schemas
from parcelry.plans import files
from parcelry.plans.layout import read_bucketed, write_bucketed
from parcelry.session import ensure_conf

RUN_COL, BATCH_COL = "run_id", "batch_id"


def orders_rows(facts: DataFrame) -> DataFrame:
    """The orders table (``shardkey`` stored as ``shard_key``)."""
    return facts.select(
        "order_uid", "track_number", "entry", "locale", "internal_signature", "customer_id",
        "delivery_service", F.col("shardkey").alias("shard_key"), "sm_id", "date_created",
        "oof_shard", "created_at", "updated_at")


def deliveries_rows(facts: DataFrame) -> DataFrame:
    """The deliveries table, keyed by ``order_uid``."""
    return facts.select("order_uid", *[F.col("delivery")[f].alias(f) for f in schemas.DELIVERY_FIELDS])


def payments_rows(facts: DataFrame) -> DataFrame:
    """The payments table, keyed by ``order_uid``."""
    return facts.select("order_uid", *[F.col("payment")[f].alias(f) for f in schemas.PAYMENT_FIELDS])


def items_rows(facts: DataFrame) -> DataFrame:
    """P5: one row per item in document order; ``item_pos`` replaces the
    serial id that carried that order."""
    x = facts.select("order_uid", F.posexplode("items").alias("item_pos", "it"))
    return x.select("order_uid", "item_pos", *[F.col("it")[f].alias(f) for f in schemas.ITEM_FIELDS])


# --------------------------------------------------------------------------
# Batch store (one nested row per order, partition per batch)
# --------------------------------------------------------------------------

def store_batch(rows: DataFrame, path: str, batch_id: int, run: str = "0", more: tuple[str, ...] = ()) -> None:
    """Write a batch's rows to ``path/run_id=R/batch_id=N``, replacing that
    partition only (dynamic overwrite), so a replayed batch is idempotent."""
    keyed = rows.withColumn(RUN_COL, F.lit(run)).withColumn(BATCH_COL, F.lit(batch_id).cast("long"))
    (keyed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy(RUN_COL, BATCH_COL, *more).parquet(path))


# Columns of a stored order: the message's, its source coordinates, audit times, partitions.
STORE_SCHEMA = T.StructType([
    *schemas.ORDER.fields,
    T.StructField("topic", T.StringType()), T.StructField("partition", T.IntegerType()), T.StructField("offset", T.LongType()),
    T.StructField("created_at", T.TimestampType()), T.StructField("updated_at", T.TimestampType()),
    T.StructField(RUN_COL, T.StringType()), T.StructField(BATCH_COL, T.LongType()),
])


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """All stored nested rows, by the fixed schema (columns that old files lack are null)."""
    ensure_conf(spark)
    return spark.read.schema(STORE_SCHEMA).parquet(path)


# --------------------------------------------------------------------------
# The four tables side by side, bucketed by order
# --------------------------------------------------------------------------

TABLES = ("orders", "deliveries", "payments", "items")


def store_tables(sources: dict[str, DataFrame], rows: dict[str, Callable[[DataFrame], DataFrame]], root: str, buckets: int) -> None:
    """Write the four tables in ``buckets`` buckets by ``order_uid``, one sorted file a bucket.

    A table's source (its columns as read, with ``order_uid``) is shuffled
    once here, and not again by joins on the key; ``rows`` makes the table's
    columns of it in place, after the shuffle.
    """
    spark = sources["orders"].sparkSession
    layout = {"buckets": buckets, "tables": {}}
    for name in TABLES:
        df = rows[name](sources[name].repartition(buckets, "order_uid"))
        write_bucketed(df, f"{root}/{name}", buckets, ["order_uid"], ["order_uid"])
        layout["tables"][name] = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    files.create_text(spark, f"{root}/_layout.json", json.dumps(layout))


def open_tables(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The bucketed scans of tables that ``store_tables`` wrote, in any session."""
    ensure_conf(spark)
    layout = json.loads(files.read_text(spark, f"{root}/_layout.json"))
    return {name: read_bucketed(spark, f"{root}/{name}", ddl, layout["buckets"], ["order_uid"], ["order_uid"])
            for name, ddl in layout["tables"].items()}


# --------------------------------------------------------------------------
# Additive migration (audit columns with a default for old rows)
# --------------------------------------------------------------------------

AUDIT_COLUMNS = ["created_at", "updated_at"]


def with_audit_columns(df: DataFrame, migration_ts: Column) -> DataFrame:
    """Up-migration: rows written before the columns existed take the
    migration time; rows that carry them keep their values."""
    out = df
    for c in AUDIT_COLUMNS:
        out = out.withColumn(c, F.coalesce(F.col(c), migration_ts) if c in df.columns else migration_ts)
    return out


def without_audit_columns(df: DataFrame) -> DataFrame:
    """Down-migration: drop the audit columns."""
    return df.drop(*AUDIT_COLUMNS)


# --------------------------------------------------------------------------
# K5: NOT NULL audit
# --------------------------------------------------------------------------

def null_audit(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, n_null, n_rows) in one aggregate."""
    g = df.agg(F.count(F.lit(1)).alias("_n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    rows = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("n_null"), F.col("_n").alias("n_rows")) for c in columns])
    return g.select(F.inline(rows))


# Columns that the tables declare NOT NULL.
NOT_NULL = {
    "orders": [c for c in schemas.ORDERS_TABLE_COLUMNS if c not in ("internal_signature", "created_at", "updated_at")],
    "deliveries": ["order_uid", *schemas.DELIVERY_FIELDS],
    "payments": ["order_uid", *[c for c in schemas.PAYMENT_FIELDS if c != "request_id"]],
    "items": ["order_uid", *schemas.ITEM_FIELDS],
}


def not_null_audits(tables: dict[str, DataFrame]) -> DataFrame:
    """K5: (table_name, column_name, n_null, n_rows) of every NOT NULL column; one aggregate a table, no join."""
    parts = [null_audit(tables[t], cols).select(F.lit(t).alias("table_name"), "*") for t, cols in NOT_NULL.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


# --------------------------------------------------------------------------
# K6: referential audits
# --------------------------------------------------------------------------

def orphan_children(children: DataFrame, orders: DataFrame, key: str = "order_uid") -> DataFrame:
    """Child rows whose order row is missing (left anti join on the key)."""
    return children.join(orders.select(key), key, "left_anti")


def orders_missing(orders: DataFrame, children: DataFrame, key: str = "order_uid") -> DataFrame:
    """Order rows with no row in a 1:1 child table."""
    return orders.join(children.select(key), key, "left_anti")
