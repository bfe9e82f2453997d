"""Relational source: the original four-table shape back to nested orders."""

from datetime import datetime, timezone

from parcelry.operators import documents as doc
from parcelry.sources.relational import nested_from_relational


def test_relational_round_trip(spark):
    t = datetime(2021, 11, 26, 6, 22, 19, tzinfo=timezone.utc)
    orders = spark.createDataFrame(
        [(7, "uid7", "TRK7", "WBIL", "en", "", "c1", "meest", "9", 99, t, "1", t, t),
         (8, "uid8", "TRK8", "WBIL", "en", "", "c2", "meest", "3", 5, t, "1", t, t)],
        "id long, order_uid string, track_number string, entry string, locale string, internal_signature string, "
        "customer_id string, delivery_service string, shard_key string, sm_id int, date_created timestamp, "
        "oof_shard string, created_at timestamp, updated_at timestamp")
    deliveries = spark.createDataFrame(
        [(7, "N", "+972501234567", "2639809", "C", "A", "R", "a@b.c"), (8, "M", "+9720000000", "1", "C", "A", "R", "x@y.z")],
        "order_id long, name string, phone string, zip string, city string, address string, region string, email string")
    payments = spark.createDataFrame(
        [(7, "uid7", "", "USD", "wbpay", 1817, 1637907727, "alpha", 1500, 317, 0),
         (8, "uid8", "", "RUB", "wbpay", 10, 1637907727, "beta", 0, 10, 0)],
        "order_id long, transaction string, request_id string, currency string, provider string, amount int, "
        "payment_dt int, bank string, delivery_cost int, goods_total int, custom_fee int")
    items = spark.createDataFrame(
        [(11, 7, 2, "TRK7", 5, "r2", "second", 0, "0", 5, 1, "b", 202),
         (10, 7, 1, "TRK7", 4, "r1", "first", 0, "0", 4, 1, "b", 202)],
        "id long, order_id long, chrt_id int, track_number string, price int, rid string, name string, sale int, "
        "size string, total_price int, nm_id int, brand string, status int")
    facts = nested_from_relational(orders, deliveries, payments, items)
    docs = {r.order_uid: r.document for r in doc.order_documents(facts).collect()}
    assert docs["uid8"].count('"items":[]') == 1
    d7 = docs["uid7"]
    assert d7.index('"name":"first"') < d7.index('"name":"second"')       # serial-id order
    assert '"shardkey":"9"' in d7 and '"date_created":"2021-11-26T06:22:19+00:00"' in d7
