"""Validation rules (R1-R16) and storage rules (K1-K3) as Column lists.

Each rule is ``(name, failed: Column)`` over a decoded order struct.  The
verdict is all-or-nothing; ``violations`` (the names of failed rules) is our
addition for diagnostics.  All rules live in one projection so that codegen
sees a single wide expression; no Python runs per row.

Patterns end with ``\\z``: in Java regex ``$`` also matches before a final
newline, which the original validator's patterns do not allow.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from parcelry import schemas
from parcelry.functions.decode import ZERO_TIME
from parcelry.functions.reference_data import ISO4217, ISO639_1

# The validator's patterns (anchors adapted to Java regex).
ALPHANUM = r"^[a-zA-Z0-9]+\z"
NUMERIC = r"^[-+]?[0-9]+(?:\.[0-9]+)?\z"
E164 = r"^\+[1-9]?[0-9]{7,14}\z"
# Fixed value: characters beyond ASCII that the validator's address pattern takes.
_WIDE = r"\u00A0-\uD7FF\uF900-\uFDCF\uFDF0-\uFFEF"
_ATOM = r"[A-Za-z0-9!#$%&'*+/=?^_`{|}~" + _WIDE + "-]++"
_LETTER, _ALNUM = f"[A-Za-z{_WIDE}]", f"[A-Za-z0-9{_WIDE}]"
_HOST = f"[A-Za-z0-9.~{_WIDE}-]"
# An address: a dot-atom or a quoted string, then a host of dot-separated labels.
# The host needs a dot; what stands before the last label starts and ends with a
# letter or digit, the last label with a letter; no empty labels (the address
# parser behind the pattern refuses them).
# Loops over groups are possessive: Java's regex recurses in the others, and a
# long hostile text would overflow its stack.  The host's conditions are
# lookarounds, so its time is linear.
EMAIL = (rf"^(?:{_ATOM}(?:\.{_ATOM})*+|\"(?:[^\"\\\r\n\x00]++|\\[^\r\n\x00])*+\")"
         rf"@(?![^@]*\.\.)(?=[^@]*{_ALNUM}\.{_LETTER}){_ALNUM}{_HOST}*+(?<={_LETTER})\z")
# BCP 47 well-formed tag (langtag form), '-' or '_' separators, any case.
BCP47_FORM = (r"^(?i)([a-z]{2,3}|[a-z]{5,8})"
              r"([-_][a-z]{3}){0,3}"
              r"([-_][a-z]{4})?"
              r"([-_]([a-z]{2}|[0-9]{3}))?"
              r"([-_]([a-z0-9]{5,8}|[0-9][a-z0-9]{3}))*"
              r"([-_][0-9a-wy-z]([-_][a-z0-9]{2,8})+)*"
              r"([-_]x([-_][a-z0-9]{1,8})+)?\z")

INT4_MIN, INT4_MAX = -2147483648, 2147483647


def _req_text(c: Column) -> Column:
    return c == ""


def _req_int(c: Column) -> Column:
    return c == 0


def _bad(c: Column, pattern: str) -> Column:
    return ~c.rlike(pattern)


def _locale_bad(c: Column) -> Column:
    primary = F.lower(F.regexp_extract(c, r"^([A-Za-z]+)", 1))
    known = F.when(F.length(primary) == 2, primary.isin(*ISO639_1)).otherwise(F.length(primary) == 3)
    # a bare language code of the list is well formed; most locales are one
    return F.when(c.isin(*ISO639_1), F.lit(False)).otherwise(~(c.rlike(BCP47_FORM) & known))


def order_rules(o: Column) -> list[tuple[str, Column]]:
    """(rule name, failed) for the order-level and nested struct fields."""
    d, p = o["delivery"], o["payment"]
    r: list[tuple[str, Column]] = [
        ("order_uid.required", _req_text(o["order_uid"])),
        ("order_uid.alphanum", _bad(o["order_uid"], ALPHANUM)),
        ("track_number.required", _req_text(o["track_number"])),
        ("track_number.alphanum", _bad(o["track_number"], ALPHANUM)),
        ("entry.required", _req_text(o["entry"])),
        ("items.min1", F.coalesce(F.size(o["items"]), F.lit(0)) < 1),
        ("locale.required", _req_text(o["locale"])),
        ("locale.bcp47", _locale_bad(o["locale"])),
        ("customer_id.required", _req_text(o["customer_id"])),
        ("delivery_service.required", _req_text(o["delivery_service"])),
        ("shardkey.required", _req_text(o["shardkey"])),
        ("shardkey.numeric", _bad(o["shardkey"], NUMERIC)),
        ("sm_id.required", _req_int(o["sm_id"])),
        ("sm_id.gt0", o["sm_id"] <= 0),
        ("date_created.required", o["date_created"] == F.to_timestamp(F.lit(ZERO_TIME))),
        ("oof_shard.required", _req_text(o["oof_shard"])),
        ("oof_shard.numeric", _bad(o["oof_shard"], NUMERIC)),
        ("delivery.name.required", _req_text(d["name"])),
        ("delivery.phone.required", _req_text(d["phone"])),
        ("delivery.phone.e164", _bad(d["phone"], E164)),
        ("delivery.zip.required", _req_text(d["zip"])),
        ("delivery.zip.numeric", _bad(d["zip"], NUMERIC)),
        ("delivery.city.required", _req_text(d["city"])),
        ("delivery.address.required", _req_text(d["address"])),
        ("delivery.region.required", _req_text(d["region"])),
        ("delivery.email.required", _req_text(d["email"])),
        ("delivery.email.email", _bad(d["email"], EMAIL)),
        ("payment.transaction.required", _req_text(p["transaction"])),
        ("payment.transaction.alphanum", _bad(p["transaction"], ALPHANUM)),
        ("payment.currency.required", _req_text(p["currency"])),
        ("payment.currency.iso4217", ~p["currency"].isin(*ISO4217)),
        ("payment.provider.required", _req_text(p["provider"])),
        ("payment.amount.required", _req_int(p["amount"])),
        ("payment.amount.gte0", p["amount"] < 0),
        ("payment.payment_dt.required", _req_int(p["payment_dt"])),
        ("payment.payment_dt.gt0", p["payment_dt"] <= 0),
        ("payment.bank.required", _req_text(p["bank"])),
        ("payment.delivery_cost.gte0", p["delivery_cost"] < 0),
        ("payment.goods_total.required", _req_int(p["goods_total"])),
        ("payment.goods_total.gt0", p["goods_total"] <= 0),
        ("payment.custom_fee.gte0", p["custom_fee"] < 0),
    ]
    return r


def item_rules(it: Column) -> list[tuple[str, Column]]:
    """(rule name, failed) for one item (applied to every element: dive)."""
    return [
        ("chrt_id.required", _req_int(it["chrt_id"])),
        ("chrt_id.gt0", it["chrt_id"] <= 0),
        ("track_number.required", _req_text(it["track_number"])),
        ("track_number.alphanum", _bad(it["track_number"], ALPHANUM)),
        ("price.required", _req_int(it["price"])),
        ("price.gte0", it["price"] < 0),
        ("rid.required", _req_text(it["rid"])),
        ("rid.alphanum", _bad(it["rid"], ALPHANUM)),
        ("name.required", _req_text(it["name"])),
        ("sale.gte0", it["sale"] < 0),
        ("sale.lte100", it["sale"] > 100),
        ("size.required", _req_text(it["size"])),
        ("total_price.gte0", it["total_price"] < 0),
        ("nm_id.required", _req_int(it["nm_id"])),
        ("nm_id.gt0", it["nm_id"] <= 0),
        ("brand.required", _req_text(it["brand"])),
        ("status.required", _req_int(it["status"])),
    ]


def _names(rules: list[tuple[str, Column]], prefix: str = "") -> Column:
    arr = F.array(*[F.when(F.coalesce(bad, F.lit(True)), F.lit(prefix + name)) for name, bad in rules])
    return F.filter(arr, lambda x: x.isNotNull())


def _fails(rules: list[tuple[str, Column]]) -> Column:
    """Some rule failed (a rule without an answer counts as failed)."""
    return ~F.coalesce(reduce(lambda a, b: a & b, [~bad for _, bad in rules]), F.lit(False))


def violations(o: Column) -> Column:
    """Sorted distinct names of every failed rule (empty array = valid).

    Whether any rule failed is asked first; names are listed only then.
    """
    none = F.array().cast("array<string>")
    of_order = F.when(_fails(order_rules(o)), _names(order_rules(o))).otherwise(none)
    some_item = F.coalesce(F.exists(o["items"], lambda it: _fails(item_rules(it))), F.lit(True))
    per_item = F.transform(o["items"], lambda it: _names(item_rules(it), "items[]."))
    return F.sort_array(F.array_distinct(F.concat(of_order, F.when(some_item, F.flatten(per_item)).otherwise(none))))


def item_violations(o: Column) -> Column:
    """Per item: array of failed item-rule names, in item order."""
    return F.transform(o["items"], lambda it: _names(item_rules(it)))


# --------------------------------------------------------------------------
# Storage rules (K1-K3): what the relational store would refuse
# --------------------------------------------------------------------------

def _int4_bad(c: Column) -> Column:
    return (c < INT4_MIN) | (c > INT4_MAX)


def _nul(c: Column) -> Column:
    return F.instr(c, "\u0000") > 0


# The store's error texts (PostgreSQL messages as relayed).
ERR_INT_RANGE = "ERROR: integer out of range (SQLSTATE 22003)"
ERR_TOO_LONG = "ERROR: value too long for type character varying({n}) (SQLSTATE 22001)"
ERR_NUL = 'ERROR: invalid byte sequence for encoding "UTF8": 0x00 (SQLSTATE 22021)'

_ORDER_TEXT = ["order_uid", "track_number", "entry", "locale", "internal_signature",
               "customer_id", "delivery_service", "shardkey", "oof_shard"]
_PAYMENT_TEXT = [f for f in schemas.PAYMENT_FIELDS if f not in schemas.PAYMENT_INTS]
_ITEM_TEXT = [f for f in schemas.ITEM_FIELDS if f not in schemas.ITEM_INTS]


def _first_error(checks: list[tuple[Column, str]]) -> Column:
    out = F.lit(None).cast("string")
    for bad, msg in reversed(checks):
        out = F.when(F.coalesce(bad, F.lit(False)), F.lit(msg)).otherwise(out)
    return out


def _any(cols: list[Column]) -> Column:
    out = F.lit(False)
    for c in cols:
        out = out | F.coalesce(c, F.lit(False))
    return out


def order_row_error(o: Column) -> Column:
    """Error text of the orders-row insert, or null when it would succeed."""
    return _first_error([
        (F.length(o["locale"]) > 10, "inserting order: " + ERR_TOO_LONG.format(n=10)),
        (_int4_bad(o["sm_id"]), "inserting order: " + ERR_INT_RANGE),
        (_any([_nul(o[f]) for f in _ORDER_TEXT]), "inserting order: " + ERR_NUL),
    ])


def child_rows_error(o: Column) -> Column:
    """Error text of the first failing child insert (delivery, payment, items)."""
    d, p = o["delivery"], o["payment"]
    delivery = _any([_nul(d[f]) for f in schemas.DELIVERY_FIELDS])
    pay_len = F.length(p["currency"]) > 3
    pay_int = _any([_int4_bad(p[f]) for f in schemas.PAYMENT_INTS])
    pay_nul = _any([_nul(p[f]) for f in _PAYMENT_TEXT])
    # first failing item decides the text (items insert one by one, in order)
    def int_bad(it: Column) -> Column:
        ints = [it[f] for f in schemas.ITEM_INTS]
        return _any([F.least(*ints) < INT4_MIN, F.greatest(*ints) > INT4_MAX])  # both pass over nulls

    def nul(it: Column) -> Column:
        return _any([_nul(it[f]) for f in _ITEM_TEXT])

    bad_items = F.filter(o["items"], lambda it: int_bad(it) | nul(it))
    first = F.get(bad_items, 0)
    item_err = F.when(F.size(bad_items) > 0, F.when(int_bad(first), F.lit(ERR_INT_RANGE)).otherwise(F.lit(ERR_NUL)))
    table_err = _first_error([
        (delivery, "inserting delivery: " + ERR_NUL),
        (pay_len, "inserting payment: " + ERR_TOO_LONG.format(n=3)),
        (pay_int, "inserting payment: " + ERR_INT_RANGE),
        (pay_nul, "inserting payment: " + ERR_NUL),
    ])
    return F.coalesce(table_err, F.concat(F.lit("inserting item: "), item_err))
