"""Fixed schemas: the order document, the message envelope, stored tables.

The schema is closed: no inference anywhere.  Field order here is the
document order (it is also the JSON key order of re-assembled documents).
"""

from __future__ import annotations

from pyspark.sql import types as T

S, L, TS = T.StringType(), T.LongType(), T.TimestampType()

# JSON field names of the order message, per level, in
# document order (these must equal the original service's names).
ORDER_FIELDS = [
    "order_uid", "track_number", "entry", "delivery", "payment", "items",
    "locale", "internal_signature", "customer_id", "delivery_service",
    "shardkey", "sm_id", "date_created", "oof_shard",
]
DELIVERY_FIELDS = ["name", "phone", "zip", "city", "address", "region", "email"]
PAYMENT_FIELDS = [
    "transaction", "request_id", "currency", "provider", "amount",
    "payment_dt", "bank", "delivery_cost", "goods_total", "custom_fee",
]
ITEM_FIELDS = [
    "chrt_id", "track_number", "price", "rid", "name", "sale", "size",
    "total_price", "nm_id", "brand", "status",
]

# Integer-typed fields per level (all others are text, except the nested
# ones and date_created).
ORDER_INTS = {"sm_id"}
PAYMENT_INTS = {"amount", "payment_dt", "delivery_cost", "goods_total", "custom_fee"}
ITEM_INTS = {"chrt_id", "price", "sale", "total_price", "nm_id", "status"}

DELIVERY = T.StructType([T.StructField(f, S) for f in DELIVERY_FIELDS])
PAYMENT = T.StructType([T.StructField(f, L if f in PAYMENT_INTS else S) for f in PAYMENT_FIELDS])
ITEM = T.StructType([T.StructField(f, L if f in ITEM_INTS else S) for f in ITEM_FIELDS])


def _order_field(name: str) -> T.StructField:
    if name == "delivery":
        return T.StructField(name, DELIVERY)
    if name == "payment":
        return T.StructField(name, PAYMENT)
    if name == "items":
        return T.StructField(name, T.ArrayType(ITEM))
    if name == "date_created":
        return T.StructField(name, TS)
    return T.StructField(name, L if name in ORDER_INTS else S)


ORDER = T.StructType([_order_field(f) for f in ORDER_FIELDS])

# Kafka-shaped envelope; (topic, partition, offset) identifies a message.
HEADER = T.StructType([T.StructField("key", S), T.StructField("value", T.BinaryType())])
ENVELOPE = T.StructType([
    T.StructField("key", T.BinaryType()),
    T.StructField("value", T.BinaryType()),
    T.StructField("headers", T.ArrayType(HEADER)),
    T.StructField("topic", S),
    T.StructField("partition", T.IntegerType()),
    T.StructField("offset", L),
    T.StructField("timestamp", TS),
])
ENVELOPE_COLUMNS = [f.name for f in ENVELOPE.fields]
MESSAGE_ID = ["topic", "partition", "offset"]

# Header names used on the wire.
CREATION_HEADER = "creation_timestamp_ms"
DLQ_REASON_HEADER = "DLQ REASON"

# Column order of the normalised tables (the stored table uses shard_key
# where the message says shardkey).
ORDERS_TABLE_COLUMNS = [
    "order_uid", "track_number", "entry", "locale", "internal_signature",
    "customer_id", "delivery_service", "shard_key", "sm_id", "date_created",
    "oof_shard", "created_at", "updated_at",
]
