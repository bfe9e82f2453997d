"""Oracle SQL (DuckDB dialect) for every registered query.

Each statement recomputes a query's answer directly from the driver's
Parquet tables (registered as views), written from the fixture formulas in
FIXTURES.md -- not from the Spark code -- so the two sides are independent.
Nested values are compared as JSON text; money is integer cents; times are
text.
"""

from __future__ import annotations


def ts_text(col: str) -> str:
    """RFC 3339 UTC text, fraction only when non-zero (matches formats.timestamp_text)."""
    us = f"(((epoch_us({col}) % 1000000) + 1000000) % 1000000)"
    return (f"(strftime({col}, '%Y-%m-%dT%H:%M:%S') || CASE WHEN {us} <> 0 THEN '.' || "
            f"rtrim(lpad(CAST({us} AS VARCHAR), 6, '0'), '0') ELSE '' END || '+00:00')")


def pick(values: list[str], key: str) -> str:
    lst = ", ".join(f"'{v}'" for v in values)
    return f"([{lst}][({key}) % {len(values)} + 1])"


# Same lists as FIXTURES.md B1.
_ENTRIES = ["NORTH", "SOUTH", "EAST"]
_LOCALES = ["en", "de", "fr", "es"]
_CURRENCIES = ["USD", "EUR", "GBP", "JPY", "CAD", "AUD"]
_PROVIDERS = ["cardone", "paylane", "moneyway"]
_BANKS = ["first", "second", "third"]

# One row per order with flat order/delivery/payment fields (k = order key).
HEADERS_CTE = f"""
hdr AS (
  SELECT o.o_orderkey AS k,
    'ord' || o.o_orderkey AS order_uid,
    'TRK' || o.o_orderkey AS track_number,
    {pick(_ENTRIES, 'o.o_orderkey')} AS entry,
    c.c_name AS d_name,
    '+7' || lpad(CAST(c.c_custkey AS VARCHAR), 10, '0') AS d_phone,
    lpad(CAST(c.c_custkey % 1000000 AS VARCHAR), 6, '0') AS d_zip,
    n.n_name AS d_city, c.c_mktsegment AS d_address, r.r_name AS d_region,
    'c' || c.c_custkey || '@example.com' AS d_email,
    'ord' || o.o_orderkey AS p_transaction, '' AS p_request_id,
    {pick(_CURRENCIES, 'o.o_orderkey')} AS p_currency,
    {pick(_PROVIDERS, 'o.o_orderkey')} AS p_provider,
    CAST(round(o.o_totalprice * 100) AS BIGINT) AS p_amount,
    CAST(epoch(o.o_orderdate) AS BIGINT) AS p_payment_dt,
    {pick(_BANKS, 'o.o_orderkey')} AS p_bank,
    o.o_orderkey % 2000 AS p_delivery_cost,
    CAST(round(o.o_totalprice * 100) AS BIGINT) AS p_goods_total,
    o.o_orderkey % 100 AS p_custom_fee,
    {pick(_LOCALES, 'o.o_orderkey')} AS locale,
    '' AS internal_signature,
    'c' || o.o_custkey AS customer_id,
    o.o_orderpriority AS delivery_service,
    CAST(o.o_orderkey % 10 + 1 AS VARCHAR) AS shardkey,
    o.o_custkey % 200 + 1 AS sm_id,
    o.o_orderdate AS date_created,
    CAST(o.o_orderkey % 5 + 1 AS VARCHAR) AS oof_shard,
    o.o_orderdate AS updated_at
  FROM orders o
  JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey
  JOIN region r ON n.n_regionkey = r.r_regionkey
)"""

# One row per line item with its item fields and sort keys.
LINES_CTE = """
lines AS (
  SELECT l.l_orderkey AS k, l.l_linenumber AS ln, l.l_partkey AS pk, l.l_suppkey AS sk,
    l.l_partkey + 1 AS chrt_id,
    'TRK' || l.l_orderkey AS item_track_number,
    CAST(round(l.l_extendedprice * 100) AS BIGINT) AS price,
    'r' || l.l_orderkey || 'x' || l.l_linenumber AS rid,
    p.p_name AS item_name,
    CAST(round(l.l_discount * 100) AS BIGINT) AS sale,
    CAST(p.p_size AS VARCHAR) AS size,
    CAST(round(l.l_extendedprice * 100) AS BIGINT) * (100 - CAST(round(l.l_discount * 100) AS BIGINT)) // 100 AS total_price,
    l.l_suppkey + 1 AS nm_id,
    p.p_brand AS brand,
    202 AS status
  FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey
)"""

ITEM_STRUCT = ("{'chrt_id': chrt_id, 'track_number': item_track_number, 'price': price, 'rid': rid, "
               "'name': item_name, 'sale': sale, 'size': size, 'total_price': total_price, "
               "'nm_id': nm_id, 'brand': brand, 'status': status}")
ITEM_ORDER = "ln, pk, sk, price, sale"

ITEMS_CTE = f"""
items AS (
  SELECT k, to_json(list({ITEM_STRUCT} ORDER BY {ITEM_ORDER})) AS items_json, count(*) AS n_items
  FROM lines GROUP BY k
)"""


def document_sql(h: str = "h", i: str = "i") -> str:
    return f"""to_json({{
      'order_uid': {h}.order_uid, 'track_number': {h}.track_number, 'entry': {h}.entry,
      'delivery': {{'name': {h}.d_name, 'phone': {h}.d_phone, 'zip': {h}.d_zip, 'city': {h}.d_city,
                   'address': {h}.d_address, 'region': {h}.d_region, 'email': {h}.d_email}},
      'payment': {{'transaction': {h}.p_transaction, 'request_id': {h}.p_request_id,
                  'currency': {h}.p_currency, 'provider': {h}.p_provider, 'amount': {h}.p_amount,
                  'payment_dt': {h}.p_payment_dt, 'bank': {h}.p_bank,
                  'delivery_cost': {h}.p_delivery_cost, 'goods_total': {h}.p_goods_total,
                  'custom_fee': {h}.p_custom_fee}},
      'items': COALESCE({i}.items_json, '[]')::JSON,
      'locale': {h}.locale, 'internal_signature': {h}.internal_signature,
      'customer_id': {h}.customer_id, 'delivery_service': {h}.delivery_service,
      'shardkey': {h}.shardkey, 'sm_id': {h}.sm_id, 'date_created': {ts_text(h + '.date_created')},
      'oof_shard': {h}.oof_shard}})"""


ORDER_DOCUMENTS = f"""
WITH {HEADERS_CTE}, {LINES_CTE}, {ITEMS_CTE}
SELECT h.order_uid, {document_sql()} AS document
FROM hdr h LEFT JOIN items i ON i.k = h.k
"""




# --------------------------------------------------------------------------
# Messages (FIXTURES.md B2): one per order, k % 20 picks the corruption,
# k % 50 = 13 sends a second copy at offset + 1,000,000.
# --------------------------------------------------------------------------

MSGS_CTE = f"""
{HEADERS_CTE.strip()}, {LINES_CTE.strip()}, {ITEMS_CTE.strip()},
msgs AS (
  SELECT h.*, i.items_json, COALESCE(i.n_items, 0) AS n_items, cp.copy,
    h.k % 20 AS r, CASE WHEN h.k % 20 IN (15, 16) THEN (h.k // 20) % 6 ELSE -1 END AS s, 'orders' AS topic, CAST(h.k % 4 AS INTEGER) AS "partition",
    h.k // 4 + cp.copy * 1000000 AS "offset"
  FROM hdr h LEFT JOIN items i ON i.k = h.k
  JOIN (VALUES (0), (1)) cp(copy) ON cp.copy = 0 OR h.k % 50 = 13
)"""


# Item lists of residue 15: every item breaks the rule of subcase s.
BAD_ITEMS_CTE = f"""
bad AS (
  SELECT k, to_json(list({{
    'chrt_id': CASE WHEN s = 4 THEN 0 ELSE chrt_id END, 'track_number': item_track_number, 'price': price,
    'rid': CASE WHEN s = 2 THEN 'r-x' ELSE rid END, 'name': CASE WHEN s = 1 THEN '' ELSE item_name END,
    'sale': CASE WHEN s = 0 THEN 101 ELSE sale END, 'size': size,
    'total_price': CASE WHEN s = 3 THEN -1 ELSE total_price END, 'nm_id': nm_id, 'brand': brand,
    'status': CASE WHEN s = 5 THEN 0 ELSE status END}} ORDER BY {ITEM_ORDER})) AS bad_json
  FROM (SELECT *, (k // 20) % 6 AS s FROM lines WHERE k % 20 = 15) GROUP BY k
)"""


def _message_json(extra: bool) -> str:
    tail = ", 'coupon': 'none'" if extra else ""
    return f"""to_json({{
      'order_uid': m.order_uid,
      'track_number': CASE WHEN m.r = 16 AND m.s = 0 THEN '' WHEN m.r = 16 AND m.s = 1 THEN 'TRK-1' ELSE m.track_number END,
      'entry': CASE WHEN m.r = 16 AND m.s = 3 THEN '' ELSE m.entry END,
      'delivery': {{'name': m.d_name,
                   'phone': CASE WHEN m.r = 0 THEN '12345abc' ELSE m.d_phone END,
                   'zip': m.d_zip, 'city': m.d_city, 'address': m.d_address, 'region': m.d_region,
                   'email': CASE WHEN m.r = 1 AND m.k // 20 % 2 = 0 THEN 'not-an-email' WHEN m.r = 1 THEN 'user@localhost' ELSE m.d_email END}},
      'payment': {{'transaction': m.p_transaction, 'request_id': m.p_request_id,
                  'currency': CASE WHEN m.r = 8 THEN 'NOT' ELSE m.p_currency END,
                  'provider': m.p_provider,
                  'amount': CASE WHEN m.r = 2 THEN -100 ELSE m.p_amount END,
                  'payment_dt': CASE WHEN m.r = 12 THEN 2147483648 ELSE m.p_payment_dt END,
                  'bank': m.p_bank, 'delivery_cost': m.p_delivery_cost,
                  'goods_total': CASE WHEN m.r = 7 THEN 0 ELSE m.p_goods_total END,
                  'custom_fee': m.p_custom_fee}},
      'items': CASE WHEN m.r = 4 THEN '[]' WHEN m.r = 15 THEN COALESCE(bad.bad_json, '[]') ELSE COALESCE(m.items_json, '[]') END::JSON,
      'locale': CASE WHEN m.r = 3 THEN 'xx_123' WHEN m.r = 16 AND m.s = 5 THEN 'en-variant1' ELSE m.locale END,
      'internal_signature': m.internal_signature,
      'customer_id': CASE WHEN m.r = 16 AND m.s = 4 THEN m.customer_id || '@NUL@' ELSE m.customer_id END, 'delivery_service': m.delivery_service,
      'shardkey': CASE WHEN m.r = 5 THEN 'abc' ELSE m.shardkey END,
      'sm_id': CASE WHEN m.r = 6 THEN 0 WHEN m.r = 11 THEN 2147483648 ELSE m.sm_id END,
      'date_created': CASE WHEN m.r = 16 AND m.s = 2 THEN '0001-01-01T00:00:00Z' ELSE strftime(m.date_created, '%Y-%m-%dT%H:%M:%SZ') END,
      'oof_shard': m.oof_shard{tail}}})"""


SYNTHETIC_ORDER_MESSAGES = f"""
WITH {MSGS_CTE}, {BAD_ITEMS_CTE}
SELECT m.topic, m."partition", m."offset",
  {ts_text('m.date_created')} AS ts,
  epoch_ms(m.date_created) AS creation_ms,
  CASE WHEN m.r = 9 AND (m.k // 20) % 2 = 1 THEN upper(sha256('ord' || m.k))
       WHEN m.r = 9 THEN hex('{{"order_uid": "invalid-' || m.k || '", "items": [}}')
       WHEN m.r = 10 THEN hex({_message_json(True)})
       WHEN m.r = 14 THEN hex(replace({_message_json(False)}::VARCHAR, '"', chr(39)))
       ELSE hex(replace({_message_json(False)}::VARCHAR, '@NUL@', '\\u0000')) END AS value_hex
FROM msgs m LEFT JOIN bad ON bad.k = m.k
"""

# Expected per-message facts from residues (no JSON parsing on this side).
EXPECT_CTE = f"""
{MSGS_CTE.strip()},
expect AS (
  SELECT m.*,
    m.r NOT IN (9, 10, 14) AS decode_ok,
    CASE WHEN m.r IN (9, 14) THEN 'malformed' WHEN m.r = 10 THEN 'unknown_field' END AS decode_error,
    array_to_string(list_sort(list_filter([
      CASE WHEN m.r = 0 THEN 'delivery.phone.e164' END,
      CASE WHEN m.r = 1 THEN 'delivery.email.email' END,
      CASE WHEN m.r = 2 THEN 'payment.amount.gte0' END,
      CASE WHEN m.r = 3 THEN 'locale.bcp47' END,
      CASE WHEN m.r = 4 OR m.n_items = 0 THEN 'items.min1' END,
      CASE WHEN m.r = 5 THEN 'shardkey.numeric' END,
      CASE WHEN m.r = 6 THEN 'sm_id.required' END,
      CASE WHEN m.r = 6 THEN 'sm_id.gt0' END,
      CASE WHEN m.r = 7 THEN 'payment.goods_total.required' END,
      CASE WHEN m.r = 7 THEN 'payment.goods_total.gt0' END,
      CASE WHEN m.r = 8 THEN 'payment.currency.iso4217' END,
      CASE WHEN m.r = 15 AND m.n_items > 0 AND m.s = 0 THEN 'items[].sale.lte100' END,
      CASE WHEN m.r = 15 AND m.n_items > 0 AND m.s = 1 THEN 'items[].name.required' END,
      CASE WHEN m.r = 15 AND m.n_items > 0 AND m.s = 2 THEN 'items[].rid.alphanum' END,
      CASE WHEN m.r = 15 AND m.n_items > 0 AND m.s = 3 THEN 'items[].total_price.gte0' END,
      CASE WHEN m.r = 15 AND m.n_items > 0 AND m.s = 4 THEN 'items[].chrt_id.required' END,
      CASE WHEN m.r = 15 AND m.n_items > 0 AND m.s = 4 THEN 'items[].chrt_id.gt0' END,
      CASE WHEN m.r = 15 AND m.n_items > 0 AND m.s = 5 THEN 'items[].status.required' END,
      CASE WHEN m.r = 16 AND m.s = 0 THEN 'track_number.required' END,
      CASE WHEN m.r = 16 AND m.s IN (0, 1) THEN 'track_number.alphanum' END,
      CASE WHEN m.r = 16 AND m.s = 2 THEN 'date_created.required' END,
      CASE WHEN m.r = 16 AND m.s = 3 THEN 'entry.required' END
    ], lambda x: x IS NOT NULL)), ',') AS violations,
    CASE WHEN m.r = 11 THEN 'inserting order: ERROR: integer out of range (SQLSTATE 22003)'
         WHEN m.r = 16 AND m.s = 4 THEN 'inserting order: ERROR: invalid byte sequence for encoding "UTF8": 0x00 (SQLSTATE 22021)'
         WHEN m.r = 16 AND m.s = 5 THEN 'inserting order: ERROR: value too long for type character varying(10) (SQLSTATE 22001)'
    END AS order_error,
    CASE WHEN m.r = 12 THEN 'inserting payment: ERROR: integer out of range (SQLSTATE 22003)' END AS child_error
  FROM msgs m
),
outcome AS (
  SELECT e.*,
    CASE WHEN NOT e.decode_ok THEN 'invalid'
         WHEN e.violations <> '' THEN 'invalid'
         WHEN COALESCE(e.order_error, e.child_error) IS NOT NULL THEN 'error'
         WHEN e.copy = 1 THEN 'invalid'
         ELSE 'valid' END AS status,
    CASE WHEN NOT e.decode_ok THEN NULL
         WHEN e.violations <> '' THEN 'invalid_order'
         WHEN COALESCE(e.order_error, e.child_error) IS NOT NULL THEN 'unhandled_error'
         WHEN e.copy = 1 THEN 'already_exists'
         ELSE NULL END AS reason,
    CASE WHEN NOT e.decode_ok THEN NULL
         WHEN e.violations <> '' THEN 'validation failed: invalid order'
         WHEN COALESCE(e.order_error, e.child_error) IS NOT NULL THEN 'failed to save order: ' || COALESCE(e.order_error, e.child_error)
         WHEN e.copy = 1 THEN 'failed to save order: record already exists: uid=' || e.order_uid
         ELSE NULL END AS error_text
  FROM expect e
)"""

DECODE_VERDICTS = f"""
WITH {EXPECT_CTE}
SELECT topic, "partition", "offset", decode_ok, decode_error FROM expect
"""

VALIDATION_VERDICTS = f"""
WITH {EXPECT_CTE}
SELECT "partition", "offset", order_uid, violations = '' AS valid, violations
FROM expect WHERE decode_ok
"""

RULE_VIOLATION_COUNTS = f"""
WITH {EXPECT_CTE}
SELECT rule, count(*) AS n
FROM (SELECT unnest(string_split(violations, ',')) AS rule FROM expect WHERE decode_ok AND violations <> '')
GROUP BY rule
"""

ITEM_RULE_FAILURES = f"""
WITH {EXPECT_CTE}
SELECT rule, CAST(sum(n_items) AS BIGINT) AS n_items, count(*) AS n_orders
FROM (SELECT n_items, unnest(CASE s WHEN 0 THEN ['sale.lte100'] WHEN 1 THEN ['name.required'] WHEN 2 THEN ['rid.alphanum']
        WHEN 3 THEN ['total_price.gte0'] WHEN 4 THEN ['chrt_id.required', 'chrt_id.gt0'] ELSE ['status.required'] END) AS rule
      FROM expect WHERE r = 15 AND n_items > 0)
GROUP BY rule
"""

STORABLE_VERDICTS = f"""
WITH {EXPECT_CTE}
SELECT "partition", "offset", order_uid, order_error, child_error
FROM expect WHERE decode_ok AND violations = ''
"""

MESSAGE_OUTCOMES = f"""
WITH {EXPECT_CTE}
SELECT topic, "partition", "offset", CASE WHEN decode_ok THEN order_uid END AS order_uid,
  status, reason, error_text, reason IS NOT NULL AS dead_lettered
FROM outcome
"""

OUTCOMES_BY_STATUS = f"""
WITH {EXPECT_CTE}
SELECT status, count(*) AS n FROM outcome GROUP BY status
"""

DEAD_LETTERS_BY_REASON = f"""
WITH {EXPECT_CTE}
SELECT reason, count(*) AS n FROM outcome WHERE reason IS NOT NULL GROUP BY reason
"""

DEAD_LETTER_MESSAGES = f"""
WITH {EXPECT_CTE}
SELECT "partition", "offset", reason, 2 AS n_headers,
  'creation_timestamp_ms' AS first_header, 'DLQ REASON' AS last_header, error_text AS dlq_reason
FROM outcome WHERE reason IS NOT NULL
"""

DUPLICATE_ORDERS = f"""
WITH {EXPECT_CTE}
SELECT order_uid, count(*) AS n_messages FROM expect WHERE decode_ok
GROUP BY order_uid HAVING count(*) > 1
"""

FIRST_ORDER_PER_UID = f"""
WITH {EXPECT_CTE}
SELECT order_uid, "partition", min("offset") AS "offset" FROM expect WHERE decode_ok
GROUP BY order_uid, "partition"
"""

MESSAGE_CREATION_TIME = f"""
WITH {MSGS_CTE}
SELECT "partition", "offset", epoch_ms(date_created) AS created_ms,
  {ts_text('date_created')} AS created_at
FROM msgs
"""

MESSAGE_ORACLES = {
    "synthetic_order_messages": SYNTHETIC_ORDER_MESSAGES,
    "decode_verdicts": DECODE_VERDICTS,
    "validation_verdicts": VALIDATION_VERDICTS,
    "rule_violation_counts": RULE_VIOLATION_COUNTS,
    "item_rule_failures": ITEM_RULE_FAILURES,
    "storable_verdicts": STORABLE_VERDICTS,
    "message_outcomes": MESSAGE_OUTCOMES,
    "outcomes_by_status": OUTCOMES_BY_STATUS,
    "dead_letters_by_reason": DEAD_LETTERS_BY_REASON,
    "dead_letter_messages": DEAD_LETTER_MESSAGES,
    "duplicate_orders": DUPLICATE_ORDERS,
    "first_order_per_uid": FIRST_ORDER_PER_UID,
    "message_creation_time": MESSAGE_CREATION_TIME,
    "stamped_messages": f"""
WITH {HEADERS_CTE}, {LINES_CTE}, {ITEMS_CTE}
SELECT h.order_uid, 'creation_timestamp_ms' AS header_key,
  CAST(epoch_ms(h.date_created) AS VARCHAR) AS header_value,
  CAST(octet_length(encode({document_sql()})) AS INTEGER) AS value_bytes
FROM hdr h LEFT JOIN items i ON i.k = h.k
""",
}


# --------------------------------------------------------------------------
# Normalised tables and read-side views
# --------------------------------------------------------------------------

BASE_CTE = f"""
base AS (
  SELECT o.o_orderkey AS k, 'ord' || o.o_orderkey AS order_uid, 'TRK' || o.o_orderkey AS track_number,
    {pick(_ENTRIES, 'o.o_orderkey')} AS entry, {pick(_LOCALES, 'o.o_orderkey')} AS locale,
    '' AS internal_signature, 'c' || o.o_custkey AS customer_id, o.o_orderpriority AS delivery_service,
    CAST(o.o_orderkey % 10 + 1 AS VARCHAR) AS shard_key, o.o_custkey % 200 + 1 AS sm_id,
    o.o_orderdate AS date_created, CAST(o.o_orderkey % 5 + 1 AS VARCHAR) AS oof_shard,
    'ord' || o.o_orderkey AS transaction, '' AS request_id,
    {pick(_CURRENCIES, 'o.o_orderkey')} AS currency, {pick(_PROVIDERS, 'o.o_orderkey')} AS provider,
    CAST(round(o.o_totalprice * 100) AS BIGINT) AS amount, CAST(epoch(o.o_orderdate) AS BIGINT) AS payment_dt,
    {pick(_BANKS, 'o.o_orderkey')} AS bank, o.o_orderkey % 2000 AS delivery_cost,
    CAST(round(o.o_totalprice * 100) AS BIGINT) AS goods_total, o.o_orderkey % 100 AS custom_fee
  FROM orders o
)"""

ORDERS_ROWS = f"""
WITH {BASE_CTE}
SELECT order_uid, track_number, entry, locale, internal_signature, customer_id, delivery_service,
  shard_key, sm_id, {ts_text('date_created')} AS date_created, oof_shard,
  {ts_text('date_created')} AS created_at, {ts_text('date_created')} AS updated_at
FROM base
"""

DELIVERIES_ROWS = f"""
WITH {HEADERS_CTE}
SELECT order_uid, d_name AS name, d_phone AS phone, d_zip AS zip, d_city AS city,
  d_address AS address, d_region AS region, d_email AS email
FROM hdr
"""

PAYMENTS_ROWS = f"""
WITH {BASE_CTE}
SELECT order_uid, transaction, request_id, currency, provider, amount, payment_dt, bank,
  delivery_cost, goods_total, custom_fee
FROM base
"""

ITEMS_ROWS = f"""
WITH {LINES_CTE}
SELECT 'ord' || k AS order_uid,
  CAST(row_number() OVER (PARTITION BY k ORDER BY {ITEM_ORDER}) - 1 AS INTEGER) AS item_pos,
  chrt_id, item_track_number AS track_number, price, rid, item_name AS name, sale, size,
  total_price, nm_id, brand, status
FROM lines
"""

ITEMS_PER_ORDER = f"""
WITH {LINES_CTE}, {ITEMS_CTE}
SELECT 'ord' || k AS order_uid, n_items, items_json FROM items
"""

ORDER_BY_UID = f"""
WITH {HEADERS_CTE}, {LINES_CTE}, {ITEMS_CTE}
SELECT h.order_uid, {document_sql()} AS document
FROM hdr h LEFT JOIN items i ON i.k = h.k
WHERE h.k IN (SELECT user_id FROM events)
"""

FLAT_ORDER_COLS = """h.order_uid, h.track_number AS order_track_number, h.entry, h.locale,
  h.internal_signature, h.customer_id, h.delivery_service, h.shardkey AS shard_key, h.sm_id,
  {dc} AS date_created, h.oof_shard,
  h.d_name AS delivery_name, h.d_phone AS phone, h.d_zip AS zip, h.d_city AS city,
  h.d_address AS address, h.d_region AS region, h.d_email AS email,
  h.p_transaction AS transaction, h.p_request_id AS request_id, h.p_currency AS currency,
  h.p_provider AS provider, h.p_amount AS amount, h.p_payment_dt AS payment_dt, h.p_bank AS bank,
  h.p_delivery_cost AS delivery_cost, h.p_goods_total AS goods_total, h.p_custom_fee AS custom_fee""".format(
    dc=ts_text("h.date_created"))

ORDER_ITEM_FLAT = f"""
WITH {HEADERS_CTE}, {LINES_CTE},
pos AS (SELECT *, CAST(row_number() OVER (PARTITION BY k ORDER BY {ITEM_ORDER}) - 1 AS INTEGER) AS item_pos FROM lines)
SELECT {FLAT_ORDER_COLS}, l.item_pos,
  l.chrt_id, l.item_track_number, l.price, l.rid, l.item_name, l.sale, l.size, l.total_price,
  l.nm_id, l.brand, l.status
FROM hdr h LEFT JOIN pos l ON l.k = h.k
"""

ORDER_SUMMARY = f"""
WITH {HEADERS_CTE}, {LINES_CTE}, {ITEMS_CTE}
SELECT {FLAT_ORDER_COLS}, CAST(COALESCE(i.n_items, 0) AS INTEGER) AS n_items
FROM hdr h LEFT JOIN items i ON i.k = h.k
"""

_SIZE_ITEMS_CTE = """
isz AS (
  SELECT k, count(*) AS n, sum(strlen(item_track_number) + strlen(rid) + strlen(item_name)
                              + strlen(size) + strlen(brand)) AS txt
  FROM lines GROUP BY k
)"""

SIZE_SQL = """(440 + strlen(h.order_uid) + strlen(h.track_number) + strlen(h.entry) + strlen(h.locale)
  + strlen(h.internal_signature) + strlen(h.customer_id) + strlen(h.delivery_service)
  + strlen(h.shardkey) + strlen(h.oof_shard)
  + strlen(h.d_name) + strlen(h.d_phone) + strlen(h.d_zip) + strlen(h.d_city) + strlen(h.d_address)
  + strlen(h.d_region) + strlen(h.d_email)
  + strlen(h.p_transaction) + strlen(h.p_request_id) + strlen(h.p_currency) + strlen(h.p_provider)
  + strlen(h.p_bank) + 128 * COALESCE(s.n, 0) + COALESCE(s.txt, 0))"""

ORDER_SIZES = f"""
WITH {HEADERS_CTE}, {LINES_CTE}, {_SIZE_ITEMS_CTE}
SELECT h.order_uid, CAST({SIZE_SQL} AS BIGINT) AS size_bytes
FROM hdr h LEFT JOIN isz s ON s.k = h.k
"""

LATEST_ORDERS = f"""
WITH {HEADERS_CTE}, {LINES_CTE}, {ITEMS_CTE}, {_SIZE_ITEMS_CTE},
top AS (SELECT * FROM hdr ORDER BY updated_at DESC NULLS FIRST, order_uid LIMIT 250)
SELECT CAST(row_number() OVER (ORDER BY h.updated_at DESC NULLS FIRST, h.order_uid) AS INTEGER) AS rank,
  h.order_uid, {document_sql()} AS document, CAST({SIZE_SQL} AS BIGINT) AS size_bytes
FROM top h LEFT JOIN items i ON i.k = h.k LEFT JOIN isz s ON s.k = h.k
"""

HOT_ORDERS = f"""
SELECT * FROM ({LATEST_ORDERS}) t WHERE size_bytes <= 1100
"""

ORDERS_WITH_AUDIT_COLUMNS = f"""
WITH {BASE_CTE}
SELECT order_uid, track_number, entry, locale, internal_signature, customer_id, delivery_service,
  shard_key, sm_id, {ts_text('date_created')} AS date_created, oof_shard,
  '2024-01-01T00:00:00+00:00' AS created_at, '2024-01-01T00:00:00+00:00' AS updated_at
FROM base
"""

# Orders of which no message is stored: their children are orphans of the store.
UNSTORED_CTE = f"""
{EXPECT_CTE.strip()},
unstored AS (SELECT k FROM outcome GROUP BY k HAVING count_if(status = 'valid') = 0)"""

ORPHAN_ITEMS = f"""
WITH {UNSTORED_CTE},
pos AS (SELECT *, CAST(row_number() OVER (PARTITION BY k ORDER BY {ITEM_ORDER}) - 1 AS INTEGER) AS item_pos FROM lines)
SELECT 'ord' || k AS order_uid, item_pos, chrt_id FROM pos WHERE k IN (SELECT k FROM unstored)
"""

ORPHAN_PAYMENTS = f"""
WITH {UNSTORED_CTE}
SELECT 'ord' || k AS order_uid, CAST(round(o_totalprice * 100) AS BIGINT) AS amount
FROM unstored JOIN orders ON k = o_orderkey
"""

ORPHAN_DELIVERIES = f"""
WITH {UNSTORED_CTE}
SELECT h.order_uid, h.d_name AS name FROM unstored u JOIN hdr h ON h.k = u.k
"""

ORPHAN_ORDERS = f"""
WITH {UNSTORED_CTE}
SELECT 'ord' || k AS order_uid FROM unstored
"""

NOT_NULL_AUDIT = f"""
WITH {HEADERS_CTE}, {LINES_CTE},
f AS (SELECT h.k, l.chrt_id, l.rid, l.brand FROM hdr h LEFT JOIN lines l ON l.k = h.k)
SELECT unnest(['order_uid', 'delivery_name', 'amount', 'chrt_id', 'rid', 'brand']) AS column_name,
  unnest([0, 0, 0, count_if(chrt_id IS NULL), count_if(rid IS NULL), count_if(brand IS NULL)]) AS n_null,
  unnest([count(*), count(*), count(*), count(*), count(*), count(*)]) AS n_rows
FROM f
"""

LATEST_ORDERS_STORED = f"""
WITH {HEADERS_CTE}, {LINES_CTE}, {ITEMS_CTE},
top AS (SELECT * FROM hdr ORDER BY updated_at DESC NULLS FIRST, order_uid LIMIT 250)
SELECT CAST(row_number() OVER (ORDER BY h.updated_at DESC NULLS FIRST, h.order_uid) AS INTEGER) AS rank,
  h.order_uid, {document_sql()} AS document
FROM top h LEFT JOIN items i ON i.k = h.k
"""

ORDER_LOOKUP_STORED = f"""
WITH {HEADERS_CTE}, {LINES_CTE}, {ITEMS_CTE},
asked AS (SELECT user_id FROM events GROUP BY user_id ORDER BY count(*) DESC, user_id LIMIT 100)
SELECT h.order_uid, {document_sql()} AS document
FROM hdr h LEFT JOIN items i ON i.k = h.k
WHERE h.k IN (SELECT user_id FROM asked)
"""

STREAMED_MESSAGE_OUTCOMES = f"""
WITH {EXPECT_CTE}
SELECT topic, "partition", "offset", CASE WHEN decode_ok THEN order_uid END AS order_uid, status, reason FROM outcome
"""


STREAMING_ORPHAN_PAYMENTS = f"""
WITH {EXPECT_CTE},
stored AS (SELECT DISTINCT order_uid FROM outcome WHERE status = 'valid'),
pay AS (SELECT 'ord' || o_orderkey AS order_uid, o_orderdate AS ts, CAST(round(o_totalprice * 100) AS BIGINT) AS amount FROM orders),
mark AS (SELECT least(max(ts), max(ts) FILTER (WHERE order_uid IN (SELECT order_uid FROM stored))) - INTERVAL 1 DAY AS wm FROM pay)
SELECT order_uid, amount FROM pay, mark
WHERE order_uid NOT IN (SELECT order_uid FROM stored) AND ts + INTERVAL 36 HOUR < wm
"""


def _not_null(table: str, sql: str, columns: list[str]) -> str:
    names = ", ".join(f"'{c}'" for c in columns)
    counts = ", ".join(f'count_if("{c}" IS NULL)' for c in columns)
    return f"SELECT '{table}' AS table_name, unnest([{names}]) AS column_name, unnest([{counts}]) AS n_null, count(*) AS n_rows FROM ({sql})"


HOT_ORDER_ITEMS = f"""
WITH {HEADERS_CTE}, {LINES_CTE}, {ITEMS_CTE},
top AS (SELECT * FROM hdr ORDER BY updated_at DESC NULLS FIRST, order_uid LIMIT 250)
SELECT count(*) AS n_orders, CAST(COALESCE(sum(i.n_items), 0) AS BIGINT) AS n_items FROM top h LEFT JOIN items i ON i.k = h.k
"""

TABLE_ORACLES = {
    "orders_rows": ORDERS_ROWS,
    "deliveries_rows": DELIVERIES_ROWS,
    "payments_rows": PAYMENTS_ROWS,
    "items_rows": ITEMS_ROWS,
    "order_documents_from_tables": ORDER_DOCUMENTS,
    "items_per_order": ITEMS_PER_ORDER,
    "order_by_uid": ORDER_BY_UID,
    "order_item_flat": ORDER_ITEM_FLAT,
    "order_summary": ORDER_SUMMARY,
    "order_sizes": ORDER_SIZES,
    "latest_orders": LATEST_ORDERS,
    "hot_orders": HOT_ORDERS,
    "orders_with_audit_columns": ORDERS_WITH_AUDIT_COLUMNS,
    "orphan_items": ORPHAN_ITEMS,
    "orphan_orders": ORPHAN_ORDERS,
    "orphan_payments": ORPHAN_PAYMENTS,
    "orphan_deliveries": ORPHAN_DELIVERIES,
    "not_null_audit": NOT_NULL_AUDIT,
    "not_null_columns": " UNION ALL ".join([
        _not_null("orders", ORDERS_ROWS, ["order_uid", "track_number", "entry", "locale", "customer_id", "delivery_service", "shard_key", "sm_id",
                                          "date_created", "oof_shard"]),
        _not_null("deliveries", DELIVERIES_ROWS, ["order_uid", "name", "phone", "zip", "city", "address", "region", "email"]),
        _not_null("payments", PAYMENTS_ROWS, ["order_uid", "transaction", "currency", "provider", "amount", "payment_dt", "bank", "delivery_cost",
                                              "goods_total", "custom_fee"]),
        _not_null("items", ITEMS_ROWS, ["order_uid", "chrt_id", "track_number", "price", "rid", "name", "sale", "size", "total_price", "nm_id",
                                        "brand", "status"]),
    ]),
    "order_documents_bucketed": ORDER_DOCUMENTS,
    "latest_orders_stored": LATEST_ORDERS_STORED,
    "order_lookup_stored": ORDER_LOOKUP_STORED,
    "streamed_message_outcomes": STREAMED_MESSAGE_OUTCOMES,
    "streaming_orphan_payments": STREAMING_ORPHAN_PAYMENTS,
    "hot_order_items": HOT_ORDER_ITEMS,
}



# --------------------------------------------------------------------------
# Operational logs from events (FIXTURES.md B3)
# --------------------------------------------------------------------------

def bucket(col: str, seconds: int) -> str:
    step = seconds * 1000000
    return f"make_timestamp(CAST(floor(epoch_us({col}) / {step}) * {step} AS BIGINT))"


LOGS_CTE = """
outc AS (
  SELECT event_id, ts,
    CASE WHEN event_type IN ('view', 'click', 'purchase') THEN 'valid'
         WHEN event_type = 'signup' THEN 'invalid' WHEN event_type = 'error' THEN 'error' END AS status,
    CASE WHEN event_type = 'signup' THEN 'invalid_order' WHEN event_type = 'error' THEN 'unhandled_error' END AS reason
  FROM events
),
req AS (
  SELECT event_id, ts, 'GET' AS method,
    CASE WHEN event_type = 'signup' THEN '/home' ELSE '/orders/' || user_id END AS raw_path,
    CASE WHEN event_type = 'signup' THEN '/home' ELSE '/orders/:id' END AS path,
    CASE WHEN event_type = 'error' THEN 500 ELSE 200 END AS code,
    value / 1000 AS seconds
  FROM events
),
look AS (SELECT event_id, ts, event_id % 3 <> 0 AS hit FROM events)"""

_BOUNDS = [0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0]
_CUM = "[" + ", ".join(f"count_if(seconds <= {b})" for b in _BOUNDS) + ", count(*)]"
_LES = "[" + ", ".join(f"'{b}'" for b in _BOUNDS) + ", '+Inf']"
_BND = "[" + ", ".join(str(b) for b in _BOUNDS) + "]"


def window_rate_sql(src: str, keys: list[str], where: str = "true") -> str:
    k = ", ".join(keys)
    kc = (k + ", ") if keys else ""
    return f"""
WITH {LOGS_CTE},
b AS (SELECT {bucket('ts', 60)} AS b, {kc}count(*) AS n FROM {src} WHERE {where} GROUP BY ALL),
f AS (SELECT b - to_microseconds(CAST(j * 60000000 AS BIGINT)) AS ws, {kc}n FROM b, range(5) t(j))
SELECT {ts_text('ws')} AS window_start, {kc}sum(n) AS n, round(sum(n) / 300, 6) AS rate
FROM f GROUP BY ws{', ' + k if keys else ''}
"""


def quantile_sql(keys: list[str]) -> str:
    k = ", ".join(keys)
    n = len(_BOUNDS)
    return f"""
WITH {LOGS_CTE},
h AS (SELECT {k}, {_CUM} AS cum, count(*) AS total FROM req GROUP BY {k}),
x AS (SELECT *, 0.95 * total AS rnk,
        list_position(list_transform(cum, lambda c: CAST(c AS DOUBLE) >= 0.95 * total), true) AS idx FROM h)
SELECT {k}, round(CASE
    WHEN total <= 0 THEN 'nan'::DOUBLE
    WHEN idx > {n} THEN {_BND}[{n}]
    ELSE (CASE WHEN idx <= 1 THEN 0.0 ELSE {_BND}[idx - 1] END)
         + ({_BND}[idx] - CASE WHEN idx <= 1 THEN 0.0 ELSE {_BND}[idx - 1] END)
           * (rnk - CASE WHEN idx <= 1 THEN 0.0 ELSE cum[idx - 1] END)
           / (cum[idx] - CASE WHEN idx <= 1 THEN 0.0 ELSE cum[idx - 1] END)
  END, 6) AS p95
FROM x
"""


COUNTER_CTE = f"""
s AS (SELECT user_id AS series, ts, CAST(event_id % 500 AS DOUBLE) AS v, {bucket('ts', 300)} AS ws FROM events),
d AS (SELECT *, lag(v) OVER w AS pv, lag(ts) OVER w AS pts,
        row_number() OVER (PARTITION BY series, ws ORDER BY ts DESC) AS rn
      FROM s WINDOW w AS (PARTITION BY series, ws ORDER BY ts)),
dd AS (SELECT *, CASE WHEN pv IS NULL THEN NULL WHEN v < pv THEN v ELSE v - pv END AS delta FROM d),
inc AS (SELECT series, ws, CAST(COALESCE(sum(delta), 0) AS DOUBLE) AS increase, count(*) AS n_samples
        FROM dd GROUP BY series, ws)"""

def range_cte(modulus: int) -> str:
    """Range vectors by definition: every sample joined to every step whose range holds it."""
    return f"""
s AS (SELECT user_id % 8 AS series, event_id AS id, CAST(event_id % {modulus} AS DOUBLE) AS v,
        1704067200000000 + CAST(floor((epoch_us(ts) - 1704067200000000) / 100) AS BIGINT) AS us FROM events),
x AS (SELECT series, id, v, us, unnest(generate_series((us + 59999999) // 60000000, (us + 359999999) // 60000000 - 1)) AS k FROM s),
l AS (SELECT *, lag(v) OVER w AS pv, lag(us) OVER w AS pus, row_number() OVER (PARTITION BY series, k ORDER BY us DESC, id DESC) AS back
      FROM x WINDOW w AS (PARTITION BY series, k ORDER BY us, id)),
d AS (SELECT *, CASE WHEN v < pv THEN v ELSE v - pv END AS delta FROM l),
r AS (SELECT series, k, count(*) AS n, CAST(coalesce(sum(delta), 0) AS DOUBLE) AS raw, first(v ORDER BY us, id) AS v0,
        min(us) / 1e6 - (k * 60 - 300) AS ds, k * 60 - max(us) / 1e6 AS de, (max(us) - min(us)) / 1e6 AS span,
        max(CASE WHEN back = 1 THEN delta / nullif((us - pus) / 1e6, 0) END) AS irate
      FROM d GROUP BY series, k),
e AS (SELECT *, span / nullif(n - 1, 0) AS mean FROM r),
f AS (SELECT *, CASE WHEN ds >= mean * 1.1 THEN mean / 2 ELSE ds END AS a, CASE WHEN de >= mean * 1.1 THEN mean / 2 ELSE de END AS b FROM e),
rv AS (SELECT series, k, n, raw, irate, make_timestamp(k * 60000000) AS at_,
         raw * (span + least(a, CASE WHEN raw > 0 AND v0 >= 0 THEN span * v0 / raw ELSE a END) + b) / nullif(span, 0) AS increase FROM f)"""


GAUGE_CTE = """
pct AS (SELECT user_id AS series, ts, user_id % 3 AS m,
          round(100.0 * (1.0 - round(value) / NULLIF(round(value) + event_id % 4000, 0)), 6) AS pct
        FROM events)"""


def quantile_of(src: str, keys: list[str], bounds: list[float]) -> str:
    """histogram_quantile(0.95) over ``src`` (a subquery with ``seconds`` and the keys)."""
    k, n = ", ".join(keys), len(bounds)
    cum = "[" + ", ".join(f"count_if(seconds <= {b})" for b in bounds) + ", count(*)]"
    bnd = "[" + ", ".join(str(b) for b in bounds) + "]"
    return f"""
WITH src AS ({src}),
h AS (SELECT {k}, {cum} AS cum, count(*) AS total FROM src GROUP BY {k}),
x AS (SELECT *, list_position(list_transform(cum, lambda c: CAST(c AS DOUBLE) >= 0.95 * total), true) AS idx FROM h)
SELECT {k}, round(CASE WHEN idx > {n} THEN {bnd}[{n}]
    ELSE (CASE WHEN idx <= 1 THEN 0.0 ELSE {bnd}[idx - 1] END)
         + ({bnd}[idx] - CASE WHEN idx <= 1 THEN 0.0 ELSE {bnd}[idx - 1] END)
           * (0.95 * total - CASE WHEN idx <= 1 THEN 0.0 ELSE cum[idx - 1] END)
           / (cum[idx] - CASE WHEN idx <= 1 THEN 0.0 ELSE cum[idx - 1] END)
  END, 6) AS p95 FROM x
"""


_CACHE_BOUNDS = [0.0001, 0.00025, 0.0005, 0.001, 0.0025, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25]
_DB_BOUNDS = [0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0]
_LATENCY_MS = '("offset" * 4 + "partition") % 5000'

SERIES_ORACLES = {
    "normalized_paths": f"""
WITH {LOGS_CTE},
u AS (SELECT 'request' AS source, event_id AS id, raw_path AS path FROM req
      UNION ALL
      SELECT 'page', page_id, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) FROM pages)
SELECT source, id, path, CASE WHEN starts_with(path, '/orders/') THEN '/orders/:id' ELSE path END AS route FROM u
""",
    "path_order_uid": f"""
WITH {LOGS_CTE}
SELECT event_id, raw_path AS path,
  CASE WHEN starts_with(raw_path, '/orders/') THEN NULLIF(substr(raw_path, 9), '') END AS order_uid
FROM req
""",
    "requests_by_route_code": f"""
WITH {LOGS_CTE}
SELECT method, path, code, count(*) AS n FROM req GROUP BY method, path, code
""",
    "latency_histogram": f"""
WITH {LOGS_CTE},
h AS (SELECT method, path, {_CUM} AS cum, count(*) AS total, round(sum(seconds), 6) AS sum_value
      FROM req GROUP BY method, path)
SELECT method, path, {_LES}[i] AS le, cum[i] AS cum_count, total AS total_count, sum_value
FROM h, range(1, {len(_BOUNDS) + 2}) t(i)
""",
    "hit_miss_counts": f"""
WITH {LOGS_CTE}
SELECT count_if(hit) AS hits, count_if(NOT hit) AS misses,
  round(count_if(hit) / greatest(count(*), 1), 6) AS hit_ratio FROM look
""",
    "transient_error_counts": """
SELECT CAST(sum(event_id % 3 + 1) AS BIGINT) AS attempts, CAST(sum(event_id % 3) AS BIGINT) AS transient_errors FROM events
""",
    "message_latency": f"""
WITH {MSGS_CTE}
SELECT "partition", "offset", CAST({_LATENCY_MS} AS DOUBLE) / 1000 AS latency_seconds FROM msgs
""",
    "consumer_latency_p95": quantile_of(
        f'WITH {MSGS_CTE} SELECT "partition", CAST({_LATENCY_MS} AS DOUBLE) / 1000 AS seconds FROM msgs', ['"partition"'], _BOUNDS),
    "cache_latency_p95": quantile_of(
        "SELECT CASE WHEN event_id % 4 = 0 THEN 'set' ELSE 'get' END AS operation, value / 10000 AS seconds FROM events", ["operation"], _CACHE_BOUNDS),
    "db_latency_p95": quantile_of(
        "SELECT event_type AS operation, value / 500 AS seconds FROM events", ["operation"], _DB_BOUNDS),
    "network_transmit_rate": f"""
WITH {COUNTER_CTE.replace('% 500', '% 700')}
SELECT series % 8 AS instance, {ts_text('ws')} AS window_start, round(sum(increase) / 300, 6) AS rate
FROM inc GROUP BY series % 8, ws
""",
    "disk_usage": f"""
WITH {GAUGE_CTE}
SELECT series, {ts_text('ts')} AS ts, pct FROM pct WHERE m = 0
""",
    "load_averages": f"""
SELECT user_id AS series, {ts_text('ts')} AS ts, round(value / 1000, 3) AS load1, round(value / 2000, 3) AS load5,
  round(value / 4000, 3) AS load15
FROM events
""",
    "streaming_outcome_rate": f"""
WITH {LOGS_CTE},
b AS (SELECT {bucket('ts', 60)} AS b, status, count(*) AS n FROM outc GROUP BY ALL),
f AS (SELECT b - to_microseconds(CAST(j * 60000000 AS BIGINT)) AS ws, status, n FROM b, range(5) t(j)),
w AS (SELECT max(ts) - INTERVAL 10 MINUTE AS mark FROM events)
SELECT {ts_text('ws')} AS window_start, status, CAST(sum(n) AS BIGINT) AS n, round(sum(n) / 300, 6) AS rate
FROM f, w WHERE epoch_us(ws) + 300000000 <= (epoch_us(mark) // 1000) * 1000 GROUP BY ws, status
""",
    "request_rate_5m": window_rate_sql("req", ["method", "path", "code"]),
    "outcome_rate_5m": window_rate_sql("outc", ["status"]),
    "dead_letter_rate_5m": window_rate_sql("outc", ["reason"], "reason IS NOT NULL"),
    "hit_miss_rate_5m": window_rate_sql("(SELECT ts, CASE WHEN hit THEN 'hit' ELSE 'miss' END AS result FROM look)", ["result"]),
    "error_rate_5m": window_rate_sql("outc", [], "status = 'error'"),
    "p95_by_group": quantile_sql(["path"]),
    "histogram_quantile_95": quantile_sql(["method", "path", "code"]),
    "consumer_lag": """
WITH p AS (
  SELECT CAST(user_id % 8 AS INTEGER) AS "partition", min(event_id) AS low, max(event_id) + 1 AS high,
    max(CASE WHEN event_type = 'purchase' THEN event_id END) AS c
  FROM events GROUP BY 1)
SELECT 'orders' AS topic, "partition",
  CAST(greatest(0, CASE WHEN (CASE WHEN "partition" = 0 THEN -1 ELSE COALESCE(c, -1) END) < 0 THEN high - low
                        ELSE high - c END) AS BIGINT) AS lag
FROM p
""",
    "latest_gauge_status": f"""
WITH st AS (SELECT user_id AS series, ts, CASE WHEN event_id % 7 <> 0 THEN CAST(event_id % 2 AS DOUBLE) END AS v FROM events)
SELECT series, arg_max(v, ts) AS value,
  CASE WHEN arg_max(v, ts) = 0 THEN 'FAIL' WHEN arg_max(v, ts) = 1 THEN 'OK' END AS status,
  {ts_text('max(ts)')} AS ts
FROM st WHERE v IS NOT NULL GROUP BY series
""",
    "gauge_ratio": f"""
WITH {GAUGE_CTE}
SELECT series, {ts_text('ts')} AS ts, pct FROM pct
""",
    "gauge_bands": f"""
WITH {GAUGE_CTE}
SELECT series, {ts_text('ts')} AS ts, pct,
  CASE WHEN pct >= 90 THEN 'red' WHEN pct >= 80 THEN 'orange' WHEN pct IS NOT NULL THEN 'green' END AS band
FROM pct
""",
    "counter_increase_with_resets": f"""
WITH {COUNTER_CTE}
SELECT series, {ts_text('ws')} AS window_start, increase, n_samples, round(increase / 300, 6) AS rate FROM inc
""",
    "counter_rate_by_series": f"""
WITH {COUNTER_CTE}
SELECT series % 8 AS instance, {ts_text('ws')} AS window_start, round(sum(increase) / 300, 6) AS rate
FROM inc GROUP BY series % 8, ws
""",
    "irate_by_series": f"""
WITH {COUNTER_CTE},
ir AS (SELECT series, ws, delta / ((epoch_us(ts) - epoch_us(pts)) / 1e6) AS irate
       FROM dd WHERE rn = 1 AND delta IS NOT NULL)
SELECT series % 8 AS instance, {ts_text('ws')} AS window_start, round(100.0 - avg(irate) * 100, 6) AS cpu_pct
FROM ir GROUP BY series % 8, ws
""",
    "counter_increase_5m": f"""
WITH {range_cte(500)}
SELECT series, {ts_text('at_')} AS at, n AS n_samples, round(raw, 6) AS raw_increase, round(increase, 6) AS increase FROM rv
""",
    "network_receive_rate_5m": f"""
WITH {range_cte(500)}
SELECT series % 4 AS device, {ts_text('at_')} AS at, round(sum(increase / 300), 6) AS rate FROM rv WHERE increase IS NOT NULL GROUP BY series % 4, at_
""",
    "network_transmit_rate_5m": f"""
WITH {range_cte(700)}
SELECT series % 4 AS device, {ts_text('at_')} AS at, round(sum(increase / 300), 6) AS rate FROM rv WHERE increase IS NOT NULL GROUP BY series % 4, at_
""",
    "cpu_usage_5m": f"""
WITH {range_cte(500)}
SELECT series % 4 AS instance, {ts_text('at_')} AS at, round(100.0 - avg(irate) * 100, 6) AS cpu_pct FROM rv WHERE irate IS NOT NULL GROUP BY series % 4, at_
""",
    "trailing_5m_count": """
SELECT event_id, user_id AS key,
  count(*) OVER (PARTITION BY user_id ORDER BY ts
                 RANGE BETWEEN INTERVAL '299999999 microseconds' PRECEDING AND CURRENT ROW) AS n_trailing
FROM events
""",
    "recently_used_keys": f"""
WITH l AS (SELECT user_id AS key, max(ts) AS last_ts FROM events GROUP BY user_id
           ORDER BY last_ts DESC, key LIMIT 100)
SELECT CAST(row_number() OVER (ORDER BY last_ts DESC, key) AS INTEGER) AS rank, key, {ts_text('last_ts')} AS last_ts FROM l
""",
}


def oracle_sql() -> dict[str, str]:
    return {
        "order_documents": ORDER_DOCUMENTS,
        **MESSAGE_ORACLES,
        **TABLE_ORACLES,
        **SERIES_ORACLES,
    }


