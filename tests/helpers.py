"""Small builders for test messages (JSON text in the message envelope)."""

import copy
import json
from datetime import datetime, timezone

from parcelry import schemas

# The reference's valid test order, restated (phone +972501234567).
VALID_ORDER = {
    "order_uid": "b563feb7b2b84b6test",
    "track_number": "WBILMTESTTRACK",
    "entry": "WBIL",
    "delivery": {
        "name": "Test Testov", "phone": "+972501234567", "zip": "2639809", "city": "Kiryat Mozkin",
        "address": "Ploshad Mira 15", "region": "Kraiot", "email": "test@gmail.com",
    },
    "payment": {
        "transaction": "b563feb7b2b84b6test", "request_id": "", "currency": "USD", "provider": "wbpay",
        "amount": 1817, "payment_dt": 1637907727, "bank": "alpha", "delivery_cost": 1500,
        "goods_total": 317, "custom_fee": 0,
    },
    "items": [{
        "chrt_id": 9934930, "track_number": "WBILMTESTTRACK", "price": 453, "rid": "ab4219087a764ae0btest",
        "name": "Mascaras", "sale": 30, "size": "0", "total_price": 317, "nm_id": 2389212,
        "brand": "Vivienne Sabo", "status": 202,
    }],
    "locale": "en", "internal_signature": "", "customer_id": "test", "delivery_service": "meest",
    "shardkey": "9", "sm_id": 99, "date_created": "2021-11-26T06:22:19Z", "oof_shard": "1",
}


def order(**changes):
    o = copy.deepcopy(VALID_ORDER)
    for path, v in changes.items():
        cur = o
        parts = path.split("__")
        for p in parts[:-1]:
            cur = cur[int(p)] if isinstance(cur, list) else cur[p]
        last = parts[-1]
        if isinstance(cur, list):
            cur[int(last)] = v
        elif v is _DELETE:
            cur.pop(last, None)
        else:
            cur[last] = v
    return o


_DELETE = object()
DELETE = _DELETE


def envelope_rows(values, topic="orders", partition=0, start_offset=0, ts=None, headers=None):
    """Rows for ``schemas.ENVELOPE`` from JSON-able objects or raw str/bytes."""
    ts = ts or datetime(2024, 1, 1, tzinfo=timezone.utc)
    rows = []
    for i, v in enumerate(values):
        if isinstance(v, bytes):
            b = v
        elif isinstance(v, str):
            b = v.encode()
        else:
            b = json.dumps(v).encode()
        h = headers if headers is not None else [(schemas.CREATION_HEADER, str(int(ts.timestamp() * 1000)).encode())]
        rows.append((None, bytearray(b), [(k, bytearray(x) if x is not None else None) for k, x in h],
                     topic, partition, start_offset + i, ts))
    return rows


def envelope_df(spark, values, **kw):
    return spark.createDataFrame(envelope_rows(values, **kw), schemas.ENVELOPE)
