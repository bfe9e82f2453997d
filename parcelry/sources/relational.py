"""Relational source (S6): the four tables in their original relational shape.

For users whose orders already live in the relational store: read
``orders``, ``deliveries``, ``payments`` and ``items`` (JDBC, or Parquet
exports with the same columns) and rebuild the nested order row, keyed by
``order_uid``, with items in serial-id order (the original ``json_agg(...
ORDER BY id)``).  Column names follow the original DDL: ``orders.id``,
``*.order_id``, ``items.id``, ``orders.shard_key``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from parcelry import schemas
from parcelry.session import ensure_conf

TABLES = ["orders", "deliveries", "payments", "items"]


def read_jdbc(spark: SparkSession, url: str, table: str, properties: dict[str, str],
              partition_column: str | None = None, lower: int | None = None, upper: int | None = None,
              num_partitions: int | None = None) -> DataFrame:
    """One table over JDBC; with ``partition_column`` the read is split into
    ``num_partitions`` range queries (filters on the result push down)."""
    ensure_conf(spark)
    if partition_column:
        return spark.read.jdbc(url, table, column=partition_column, lowerBound=lower, upperBound=upper,
                               numPartitions=num_partitions, properties=properties)
    return spark.read.jdbc(url, table, properties=properties)


def nested_from_relational(orders: DataFrame, deliveries: DataFrame, payments: DataFrame,
                           items: DataFrame) -> DataFrame:
    """Nested order rows (the stored fact) from the four relational tables.

    orders JOIN deliveries JOIN payments (inner, 1:1 on the serial key) LEFT
    JOIN the items grouped per order in serial-id order; every join is on
    ``orders.id`` so each side is shuffled once on the same key.
    """
    o = orders.select(F.col("id").alias("_oid"), *[F.col(c) for c in orders.columns if c != "id"])
    d = deliveries.select(F.col("order_id").alias("_oid"),
                          F.struct(*[F.col(c) for c in schemas.DELIVERY_FIELDS]).alias("delivery"))
    p = payments.select(F.col("order_id").alias("_oid"),
                        F.struct(*[F.col(c).cast("long") if c in schemas.PAYMENT_INTS else F.col(c)
                                   for c in schemas.PAYMENT_FIELDS]).alias("payment"))
    item = F.struct(*[F.col(c).cast("long").alias(c) if c in schemas.ITEM_INTS else F.col(c) for c in schemas.ITEM_FIELDS])
    it = items.groupBy(F.col("order_id").alias("_oid")).agg(
        F.transform(F.sort_array(F.collect_list(F.struct(F.col("id").alias("i"), item.alias("item")))),
                    lambda e: e["item"]).alias("items"))
    j = o.join(d, "_oid", "inner").join(p, "_oid", "inner").join(it, "_oid", "left")
    empty = F.array().cast("array<" + schemas.ITEM.simpleString() + ">")
    cols = []
    for f in schemas.ORDER_FIELDS:
        if f == "items":
            cols.append(F.coalesce(F.col("items"), empty).alias("items"))
        elif f == "shardkey":
            cols.append(F.col("shard_key").alias("shardkey"))
        elif f in schemas.ORDER_INTS:
            cols.append(F.col(f).cast("long").alias(f))
        elif f == "date_created":
            cols.append(F.col(f).cast("timestamp").alias(f))
        else:
            cols.append(F.col(f))
    extra = [F.col(c) for c in ("created_at", "updated_at") if c in orders.columns]
    return j.select(*cols, *extra)
