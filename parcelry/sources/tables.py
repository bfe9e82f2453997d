"""Parquet table loaders and the order shape derived from the test tables.

The driver tables are TPC-H-like.  The mapping to the order model is fixed
(see FIXTURES.md, section B1): one order per ``orders`` row, its delivery from
the customer with nation and region, its payment from the order itself and
its items from ``lineitem`` with ``part``.  All choices are arithmetic on the
order key so that runs repeat and a SQL oracle can recompute them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from parcelry.plans.guards import bounded_broadcast
from parcelry.session import ensure_conf

TABLE_NAMES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels",
    "conversations",
]

# The value lists picked by key arithmetic (FIXTURES.md B1).
ENTRIES = ["NORTH", "SOUTH", "EAST"]
LOCALES = ["en", "de", "fr", "es"]
CURRENCIES = ["USD", "EUR", "GBP", "JPY", "CAD", "AUD"]
PROVIDERS = ["cardone", "paylane", "moneyway"]
BANKS = ["first", "second", "third"]
ITEM_STATUS = 202


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one table; ``timestamp_ntz`` columns become ``timestamp`` (UTC)."""
    ensure_conf(spark)
    df = spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
    cols = [
        F.col(f.name).cast("timestamp").alias(f.name)
        if isinstance(f.dataType, T.TimestampNTZType) else F.col(f.name)
        for f in df.schema.fields
    ]
    return df.select(*cols)


def pick(values: list[str], key: Column) -> Column:
    """``values[key % len(values)]`` as a Column (0-based choice)."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (key % len(values) + 1).cast("int"))


def cents(x: Column) -> Column:
    """Money in integer minor units: ``round(x * 100)`` as bigint."""
    return F.round(x * 100).cast("long")


def geo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """nation with its region name (25 rows by construction, guarded anyway)."""
    n = load(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    r = load(spark, sf_dir, "region").select("r_regionkey", "r_name")
    g = n.join(bounded_broadcast(r), n.n_regionkey == r.r_regionkey, "inner").select("n_nationkey", "n_name", "r_name")
    return bounded_broadcast(g)


def order_uid(k: Column) -> Column:
    return F.concat(F.lit("ord"), k)


def _order_fields(k: Column) -> list[Column]:
    """Order-level and payment fields, all computed from the orders row."""
    amount = cents(F.col("o_totalprice"))
    return [
        k.alias("order_key"),
        order_uid(k).alias("order_uid"),
        F.concat(F.lit("TRK"), k).alias("track_number"),
        pick(ENTRIES, k).alias("entry"),
        F.struct(
            F.concat(F.lit("ord"), k).alias("transaction"),
            F.lit("").alias("request_id"),
            pick(CURRENCIES, k).alias("currency"),
            pick(PROVIDERS, k).alias("provider"),
            amount.alias("amount"),
            F.unix_seconds(F.col("o_orderdate")).alias("payment_dt"),
            pick(BANKS, k).alias("bank"),
            (k % 2000).alias("delivery_cost"),
            amount.alias("goods_total"),
            (k % 100).alias("custom_fee"),
        ).alias("payment"),
        pick(LOCALES, k).alias("locale"),
        F.lit("").alias("internal_signature"),
        F.concat(F.lit("c"), F.col("o_custkey")).alias("customer_id"),
        F.col("o_orderpriority").alias("delivery_service"),
        (k % 10 + 1).cast("string").alias("shardkey"),
        (F.col("o_custkey") % 200 + 1).alias("sm_id"),
        F.col("o_orderdate").alias("date_created"),
        (k % 5 + 1).cast("string").alias("oof_shard"),
        F.col("o_orderdate").alias("created_at"),
        F.col("o_orderdate").alias("updated_at"),
    ]


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority")


def base_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order with the source columns of its order and payment fields (no join)."""
    return _orders(spark, sf_dir).withColumnRenamed("o_orderkey", "order_key")


def base_fields() -> list[Column]:
    """Order and payment fields, from the columns of ``base_parts``."""
    return _order_fields(F.col("order_key"))


def order_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order and payment fields from the orders table alone (no join)."""
    return base_parts(spark, sf_dir).select(*base_fields())


def _delivery(ck: Column) -> Column:
    return F.struct(
        F.col("c_name").alias("name"),
        F.concat(F.lit("+7"), F.lpad(ck.cast("string"), 10, "0")).alias("phone"),
        F.lpad((ck % 1000000).cast("string"), 6, "0").alias("zip"),
        F.col("n_name").alias("city"),
        F.col("c_mktsegment").alias("address"),
        F.col("r_name").alias("region"),
        F.concat(F.lit("c"), ck, F.lit("@example.com")).alias("email"),
    )


def header_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order with the source columns that its fields are made of (``order_key`` first).

    Plan: orders join customer on the customer key (shuffle join at scale,
    both sides grow with the data), then the guarded broadcast of the
    nation/region dimension.  Only the needed columns reach the scans.  What
    is shuffled further is this frame; ``header_fields`` come after it.
    """
    o = _orders(spark, sf_dir)
    c = load(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")
    g = geo(spark, sf_dir)
    j = o.join(c, o.o_custkey == c.c_custkey, "inner").join(g, F.col("c_nationkey") == g.n_nationkey, "inner")
    return j.select(F.col("o_orderkey").alias("order_key"), "o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority",
                    "c_name", "c_mktsegment", "n_name", "r_name")


def header_fields() -> list[Column]:
    """Every order, delivery and payment field, from the columns of ``header_parts``."""
    fields = _order_fields(F.col("order_key"))
    return [*fields[:4], _delivery(F.col("o_custkey")).alias("delivery"), *fields[4:]]


def order_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order with every order, delivery and payment field."""
    return header_parts(spark, sf_dir).select(*header_fields())


# What an item is made of besides its order's key, in the order of the items of a document.
LINE_PARTS = ["line_no", "part_key", "supp_key", "price", "sale", "name", "size", "brand"]


def line_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per line item: ``order_key`` and ``LINE_PARTS``.

    ``part`` is broadcast only under the row bound; at scale both sides are
    shuffled on the part key.  Later shuffles carry these columns; the item's
    texts repeat them and are made after (``item_struct``).
    """
    li = load(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_discount")
    p = bounded_broadcast(load(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_size"))
    j = li.join(p, li.l_partkey == p.p_partkey, "inner").select(
        "*",
        cents(F.col("l_extendedprice")).alias("price"),
        cents(F.col("l_discount")).alias("sale"),
    )
    return j.select(
        F.col("l_orderkey").alias("order_key"),
        F.col("l_linenumber").alias("line_no"),
        F.col("l_partkey").alias("part_key"),
        F.col("l_suppkey").alias("supp_key"),
        "price",
        "sale",
        F.col("p_name").alias("name"),
        F.col("p_size").cast("string").alias("size"),
        F.col("p_brand").alias("brand"),
    )


def item_struct(k: Column, part: Callable[[str], Column] = F.col) -> Column:
    """The item of order ``k`` from its ``LINE_PARTS`` (``part(name)``)."""
    net = F.call_function("div", part("price") * (F.lit(100) - part("sale")), F.lit(100).cast("long"))
    return F.struct(
        (part("part_key") + 1).alias("chrt_id"),
        F.concat(F.lit("TRK"), k).alias("track_number"),
        part("price").alias("price"),
        F.concat(F.lit("r"), k, F.lit("x"), part("line_no")).alias("rid"),
        part("name").alias("name"),
        part("sale").alias("sale"),
        part("size").alias("size"),
        net.alias("total_price"),
        (part("supp_key") + 1).alias("nm_id"),
        part("brand").alias("brand"),
        F.lit(ITEM_STATUS).cast("long").alias("status"),
    )


def item_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per line item: ``order_key``, sort keys and the item struct.

    The sort keys give a total order inside an order: ``(l_linenumber,
    l_partkey, l_suppkey)`` repeats in the data, the price and sale settle the
    rest (equal keys then mean equal items).
    """
    return line_parts(spark, sf_dir).select(
        "order_key", "line_no", "part_key", "supp_key", item_struct(F.col("order_key")).alias("item"))
