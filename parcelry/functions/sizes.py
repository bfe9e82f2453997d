"""Approximate in-memory size of a decoded order (P12), as a pure expression.

The original service sizes an order reflectively on a 64-bit runtime:
pointer + fixed struct + the bytes of every string + per item a fixed
struct plus its strings.  Here that is one Column expression over the nested
row, so it runs inside whole-stage codegen with no Python.
Deviation: list length, not list capacity, is counted.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from parcelry import schemas

# 8-byte pointer + 432-byte order struct; 128-byte item struct.
ORDER_FIXED_BYTES = 440
ITEM_FIXED_BYTES = 128

_ORDER_TEXT = [f for f in schemas.ORDER_FIELDS
               if f not in schemas.ORDER_INTS and f not in ("delivery", "payment", "items", "date_created")]
_PAYMENT_TEXT = [f for f in schemas.PAYMENT_FIELDS if f not in schemas.PAYMENT_INTS]
_ITEM_TEXT = [f for f in schemas.ITEM_FIELDS if f not in schemas.ITEM_INTS]


def _bytes(c: Column) -> Column:
    return F.coalesce(F.octet_length(c), F.lit(0)).cast("long")


def order_size(order: Column) -> Column:
    """Size in bytes of the nested order held in ``order`` (a struct column)."""
    total = F.lit(ORDER_FIXED_BYTES).cast("long")
    for f in _ORDER_TEXT:
        total = total + _bytes(order[f])
    for f in schemas.DELIVERY_FIELDS:
        total = total + _bytes(order["delivery"][f])
    for f in _PAYMENT_TEXT:
        total = total + _bytes(order["payment"][f])
    items = order["items"]
    n_items = F.greatest(F.coalesce(F.size(items), F.lit(0)), F.lit(0)).cast("long")
    item_text = F.aggregate(
        items,
        F.lit(0).cast("long"),
        lambda acc, it: acc + sum((_bytes(it[f]) for f in _ITEM_TEXT[1:]), _bytes(it[_ITEM_TEXT[0]])),
    )
    return total + n_items * ITEM_FIXED_BYTES + F.coalesce(item_text, F.lit(0).cast("long"))
