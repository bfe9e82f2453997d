"""Message envelopes: synthetic order messages (G1-G3), JSON-array files
(S2) and stamped publishing (S3).

Synthetic messages are a Spark job over the test tables: each order becomes
one JSON message; ``k % 20`` (k = order key) picks a corruption; every order
with ``k % 50 == 13`` is sent twice.  All choices are arithmetic on the key,
so runs repeat and the SQL oracle recomputes them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from parcelry import schemas
from parcelry.operators.documents import empty_items, order_facts
from parcelry.plans.derived import derived
from parcelry.sources.json_arrays import json_array_elements

TOPIC = "orders"
PARTITIONS = 4
DUPLICATE_OFFSET = 1_000_000

# The corruptions (FIXTURES.md B2; values as the original
# generator and producer use them).
BAD_PHONE = "12345abc"
BAD_EMAIL, BAD_EMAIL_HOST = "not-an-email", "user@localhost"
BAD_AMOUNT = -100
BAD_LOCALE = "xx_123"
BAD_SHARDKEY = "abc"
BAD_CURRENCY = "NOT"
INT4_OVERFLOW = 2147483648
EXTRA_FIELD = ("coupon", "none")
BAD_SALE, BAD_RID, BAD_TRACK = 101, "r-x", "TRK-1"
ZERO_TIME_TEXT = "0001-01-01T00:00:00Z"
LONG_LOCALE = "en-variant1"
SUBCASES = 6  # residues 15 and 16 split by (k div 20) % 6


def message_time_text(ts: Column) -> Column:
    """Producer time format: ``2006-01-02T15:04:05Z``."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def truncated_json(k: Column) -> Column:
    return F.concat(F.lit('{"order_uid": "invalid-'), k.cast("string"), F.lit('", "items": [}'))


def _at(r: Column, residue: int, bad: Column, good: Column) -> Column:
    return F.when(r == residue, bad).otherwise(good)


def _named(fields: list[tuple[str, Column]]) -> Column:
    """A struct whose names are literals: aliases inside a CASE branch would be trimmed."""
    return F.named_struct(*[x for name, c in fields for x in (F.lit(name), c)])


def _bad_items(s: Column) -> Column:
    """The items of residue 15: every item breaks the rule of subcase ``s``."""
    def bad(it: Column) -> Column:
        change = {
            "sale": _at(s, 0, F.lit(BAD_SALE).cast("long"), it["sale"]),
            "name": _at(s, 1, F.lit(""), it["name"]),
            "rid": _at(s, 2, F.lit(BAD_RID), it["rid"]),
            "total_price": _at(s, 3, F.lit(-1).cast("long"), it["total_price"]),
            "chrt_id": _at(s, 4, F.lit(0).cast("long"), it["chrt_id"]),
            "status": _at(s, 5, F.lit(0).cast("long"), it["status"]),
        }
        return _named([(f, change.get(f, it[f])) for f in schemas.ITEM_FIELDS])
    return F.transform("items", bad)


def corrupted_struct(facts: DataFrame, r: Column, extra: bool = False) -> Column:
    """The message struct with the corruption of residue ``r`` applied field by
    field (one struct, one CASE per touched field - not one struct per case)."""
    s = F.expr("order_key div 20") % SUBCASES
    r16 = F.when(r == 16, s).otherwise(-1)
    d, p = F.col("delivery"), F.col("payment")
    delivery = _named([
        (f, _at(r, 0, F.lit(BAD_PHONE), d[f]) if f == "phone" else
         F.when((r == 1) & (F.expr("order_key div 20") % 2 == 0), BAD_EMAIL).when(r == 1, BAD_EMAIL_HOST).otherwise(d[f]) if f == "email" else d[f])
        for f in schemas.DELIVERY_FIELDS])
    pay = {
        "amount": _at(r, 2, F.lit(BAD_AMOUNT).cast("long"), p["amount"]),
        "goods_total": _at(r, 7, F.lit(0).cast("long"), p["goods_total"]),
        "currency": _at(r, 8, F.lit(BAD_CURRENCY), p["currency"]),
        "payment_dt": _at(r, 12, F.lit(INT4_OVERFLOW).cast("long"), p["payment_dt"]),
    }
    payment = _named([(f, pay.get(f, p[f])) for f in schemas.PAYMENT_FIELDS])
    top = {
        "delivery": delivery,
        "payment": payment,
        "track_number": F.when(r16 == 0, "").when(r16 == 1, BAD_TRACK).otherwise(F.col("track_number")),
        "entry": _at(r16, 3, F.lit(""), F.col("entry")),
        "customer_id": _at(r16, 4, F.concat(F.col("customer_id"), F.lit("\u0000")), F.col("customer_id")),
        "items": F.when(r == 4, empty_items()).when(r == 15, _bad_items(s)).otherwise(F.col("items")),
        "locale": F.when(r == 3, BAD_LOCALE).when(r16 == 5, LONG_LOCALE).otherwise(F.col("locale")),
        "shardkey": _at(r, 5, F.lit(BAD_SHARDKEY), F.col("shardkey")),
        "sm_id": F.when(r == 6, F.lit(0).cast("long")).when(r == 11, F.lit(INT4_OVERFLOW).cast("long"))
                  .otherwise(F.col("sm_id")),
        "date_created": _at(r16, 2, F.lit(ZERO_TIME_TEXT), message_time_text(F.col("date_created"))),
    }
    cols = [(f, top.get(f, F.col(f))) for f in schemas.ORDER_FIELDS]
    if extra:
        cols.append((EXTRA_FIELD[0], F.lit(EXTRA_FIELD[1])))
    return _named(cols)


def stamp_headers(ms: Column) -> Column:
    """S3: the single creation-time header, value = decimal epoch ms."""
    return F.array(F.struct(F.lit(schemas.CREATION_HEADER).alias("key"),
                            ms.cast("string").cast("binary").alias("value")))


def stamped(df: DataFrame, value: Column, at: Column | None = None, keep: list[str] | None = None) -> DataFrame:
    """S3: wrap ``value`` (text or binary) in an envelope stamped with ``at``
    (default: the current time), ready for a Kafka or file sink; ``keep``
    columns pass through."""
    ts = at if at is not None else F.current_timestamp()
    return df.select(
        *(keep or []),
        F.lit(None).cast("binary").alias("key"),
        value.cast("binary").alias("value"),
        stamp_headers(F.unix_millis(ts)).alias("headers"),
    )


def order_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The envelope stream built from the test tables (all orders)."""
    facts = order_facts(spark, sf_dir)
    k = F.col("order_key")
    r = k % 20
    text = (
        F.when(r == 10, F.to_json(corrupted_struct(facts, r, extra=True)))
        .otherwise(F.to_json(corrupted_struct(facts, r)))
    )
    text = F.when(r == 14, F.replace(text, F.lit('"'), F.lit("'"))).otherwise(text)
    gibberish = F.unhex(F.sha2(F.concat(F.lit("ord"), k.cast("string")), 256))
    value = (
        F.when((r == 9) & ((k / 20).cast("long") % 2 == 0), truncated_json(k).cast("binary"))
        .when(r == 9, gibberish)
        .otherwise(text.cast("binary"))
    )
    copies = F.when(k % 50 == 13, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return facts.select(
        F.lit(None).cast("binary").alias("key"),
        value.alias("value"),
        stamp_headers(F.unix_millis(F.col("date_created"))).alias("headers"),
        F.lit(TOPIC).alias("topic"),
        (k % PARTITIONS).cast("int").alias("partition"),
        F.explode(copies).alias("_copy"),
        k.alias("_k"),
        F.col("date_created").alias("timestamp"),
    ).select(
        "key", "value", "headers", "topic", "partition",
        (F.expr(f"_k div {PARTITIONS}") + F.col("_copy") * DUPLICATE_OFFSET).alias("offset"),
        "timestamp",
    )


# --------------------------------------------------------------------------
# JSON-array files -> one raw message per element
# --------------------------------------------------------------------------

def json_array_messages(spark: SparkSession, path: str, topic: str = TOPIC) -> DataFrame:
    """Read files holding ``[{...}, {...}, ...]``; one message per element.

    Elements are passed on as they are written (``sources.json_arrays``); the
    topic of a message names its file and the offset is the element's place,
    so coordinates are unique across files.
    """
    return json_array_elements(spark, path).select(
        F.lit(None).cast("binary").alias("key"),
        F.col("elem").alias("value"),
        F.array().cast("array<struct<key:string,value:binary>>").alias("headers"),
        F.concat(F.lit(f"{topic}@"), F.col("file")).alias("topic"),
        F.lit(0).alias("partition"),
        F.col("pos").alias("offset"),
        F.lit(None).cast("timestamp").alias("timestamp"),
        F.col("file"),
    )


# --------------------------------------------------------------------------
# Materialised message table (a written table in the shared folder)
# --------------------------------------------------------------------------

# Modules whose code shapes the message rows.
GENERATORS = ("parcelry.sources.messages", "parcelry.sources.tables", "parcelry.operators.documents",
              "parcelry.functions.formats", "parcelry.schemas")


def source_paths(sf_dir: str) -> list[str]:
    """The tables that orders are built from."""
    return [f"{sf_dir.rstrip('/')}/{t}.parquet" for t in ("orders", "customer", "nation", "region", "lineitem", "part")]


def message_path(spark: SparkSession, sf_dir: str) -> str:
    """The folder of ``order_messages`` written once (``plans.derived``), the
    way messages sit in a topic or landing folder."""
    return derived(spark, "messages", source_paths(sf_dir), GENERATORS, lambda own: order_messages(spark, sf_dir).write.parquet(own, compression="zstd"))


def message_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.schema(schemas.ENVELOPE).parquet(message_path(spark, sf_dir))
