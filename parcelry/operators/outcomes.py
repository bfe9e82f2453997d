"""Message routing (T1), uniqueness (J4/W3), dead letters (S5), A2/A3.

Every message gets exactly one outcome, in this order of checks:

1. decode fails                     -> invalid, not dead-lettered
2. any validation rule fails        -> invalid, ``invalid_order``
3. the orders row is not storable   -> error, ``unhandled_error``
4. uid stored before, or won by an
   earlier message of this batch    -> invalid, ``already_exists``
5. a child row is not storable      -> error, ``unhandled_error``
6. otherwise                        -> valid (stored)

The winner of a uid is the earliest *fully storable* message by ``seq``
(time, topic, partition, offset, hash of the value); a rolled-back insert
does not hold the uid.  Rows that agree in all of these are one message
delivered twice: the first copy can be valid, the others already exist.

Plan: outcomes are decided on a narrow frame (``decide``: coordinates, uid,
errors; no payload).  Copies of a message are counted first, then stored uids
and claims are folded into one ``groupBy(uid)`` (earliest claim, stored
flag), which is combined map-side, and one join gives every message its
outcome.  With ``materialize`` the narrow frame is written
once (one decode a message) and the winners are written as a table: a join
on a scan has an exchange of its own on both sides, so AQE splits the
partition of a hot uid (a join on the aggregate itself has none on that
side, and is not split).  Messages decided by steps 1-3 carry a key that
matches no uid, so they spread evenly.  Payloads are attached by message id
only where a caller needs them (``attach``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from parcelry import schemas
from parcelry.functions.decode import decode_messages
from parcelry.functions.rules import child_rows_error, order_row_error, violations
from parcelry.plans.guards import bind, bounded_broadcast, written

# Outcome labels and error texts of the original service.
VALID, INVALID, ERROR = "valid", "invalid", "error"
R_INVALID, R_EXISTS, R_UNHANDLED = "invalid_order", "already_exists", "unhandled_error"
MSG_INVALID = "validation failed: invalid order"
MSG_EXISTS_PREFIX = "failed to save order: record already exists: uid="
MSG_SAVE_PREFIX = "failed to save order: "

SEQ_COLS = ["timestamp", "topic", "partition", "offset"]


def seq() -> Column:
    return F.struct(*[F.col(c) for c in SEQ_COLS], F.xxhash64("value").alias("value_hash"))


def message_id(value_hash: Column | None = None) -> Column:
    """Identity of a message: its source coordinates, time and a hash of its value (``value_hash`` if given); never null."""
    value_hash = F.xxhash64("value") if value_hash is None else value_hash
    parts = [F.col("topic"), F.col("partition").cast("string"), F.col("offset").cast("string"),
             F.unix_micros("timestamp").cast("string"), value_hash.cast("string")]
    return F.concat_ws("#", *[F.coalesce(c, F.lit("-")) for c in parts])


def checked_messages(messages: DataFrame) -> DataFrame:
    """Decode, rules and storage checks in narrow projections (no shuffle)."""
    d = decode_messages(messages)
    o = F.col("order")
    ok = F.col("decode_ok")
    found = {"violations": violations(o), "order_error": order_row_error(o), "child_error": child_rows_error(o), "order_uid": o["order_uid"]}
    # the projection computes (compiled); the generator only keeps it from being repeated
    x = d.select("*", *[F.when(ok, c).alias(f"_{name}") for name, c in found.items()])
    return bind(x, *[F.col(f"_{name}").alias(name) for name in found]).drop(*[f"_{name}" for name in found])


def _outcome(status: str, reason: str | None, text: Column) -> Column:
    return F.struct(F.lit(status).alias("status"), F.lit(reason).cast("string").alias("reason"),
                    text.cast("string").alias("error_text"))


def _early(c: DataFrame) -> Column:
    """Outcome decided before uniqueness: steps 1-3 (null when undecided)."""
    return (
        F.when(~F.col("decode_ok"), _outcome(INVALID, None, F.lit(None)))
        .when(F.size("violations") > 0, _outcome(INVALID, R_INVALID, F.lit(MSG_INVALID)))
        .when(F.col("order_error").isNotNull(),
              _outcome(ERROR, R_UNHANDLED, F.concat(F.lit(MSG_SAVE_PREFIX), F.col("order_error"))))
    )


def decide(checked: DataFrame, stored_uids: DataFrame | None = None, materialize: bool = False) -> DataFrame:
    """T1, narrow: one row per message without its payload.

    ``stored_uids`` (column ``order_uid``) are uids stored by earlier
    batches; they make step 4 fire across batches.  Output: ``message_id``,
    ``copy`` (1, 2, ... of rows that repeat one message), the coordinates,
    ``order_uid``, ``status``, ``reason``, ``error_text``, ``dead_lettered``.
    """
    # of the message id only its parts go through the shuffles; the text is made at the end
    n = checked.select(*SEQ_COLS, F.xxhash64("value").alias("_vh"), "order_uid", "child_error", _early(checked).alias("_early"))
    n = n.groupBy(*n.columns).agg(F.count(F.lit(1)).alias("_copies"))
    if materialize:
        n = written(n, "checked")
    pending = F.col("_early").isNull()
    place = F.struct(*[F.col(c) for c in SEQ_COLS], F.col("_vh"))
    claims = n.filter(pending & F.col("child_error").isNull()).select("order_uid", place.alias("_seq"), F.lit(False).alias("_stored"))
    if stored_uids is not None:
        prior = stored_uids.select("order_uid", F.lit(None).cast(claims.schema["_seq"].dataType).alias("_seq"), F.lit(True).alias("_stored"))
        claims = claims.unionByName(prior)
    winners = claims.groupBy(F.col("order_uid").alias("_uid")).agg(F.min("_seq").alias("_win"), F.max("_stored").alias("_stored"))
    if materialize:
        winners = written(winners, "winners")
    key = _join_key(pending, F.col("_vh").cast("string"))
    p = n.withColumn("_key", key).join(winners, F.col("_key") == F.col("_uid"), "left")
    p = p.select("*", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))).alias("copy"))
    again = (F.col("copy") > 1) & F.col("child_error").isNull()
    o = F.coalesce(F.col("_early"), _late(_taken(place) | again))
    return p.select(message_id(F.col("_vh")).alias("message_id"), "copy", *SEQ_COLS, "order_uid", o["status"].alias("status"), o["reason"].alias("reason"),
                    o["error_text"].alias("error_text"), o["reason"].isNotNull().alias("dead_lettered"))


def _join_key(pending: Column, other: Column) -> Column:
    """The uid of a message that the uniqueness step decides, else a key of its own.

    Uids that pass the rules are alphanumeric: a key with '#' matches none.
    """
    return F.when(pending, F.col("order_uid")).otherwise(F.concat(F.lit("#"), other))


def _taken(place: Column) -> Column:
    """Step 4 from the joined winner (``_win``, ``_stored``)."""
    return F.coalesce(F.col("_stored"), F.lit(False)) | (F.col("_win").isNotNull() & (F.col("_win") < place))


def _late(taken: Column) -> Column:
    """Outcome of steps 4 to 6."""
    return (
        F.when(taken, _outcome(INVALID, R_EXISTS, F.concat(F.lit(MSG_EXISTS_PREFIX), F.col("order_uid"))))
        .when(F.col("child_error").isNotNull(),
              _outcome(ERROR, R_UNHANDLED, F.concat(F.lit(MSG_SAVE_PREFIX), F.col("child_error"))))
        .otherwise(_outcome(VALID, None, F.lit(None)))
    )


def pending(checked: DataFrame) -> DataFrame:
    """``(order_uid, claims)`` of the messages that the uniqueness step decides;
    ``claims`` says that the message could be stored."""
    return checked.filter(_early(checked).isNull()).select("order_uid", F.col("child_error").isNull().alias("claims"))


LANDED_COLS = ["landed_file", "landed_row"]


def settle(landed: DataFrame, stored_uids: DataFrame, folder: str | None = None) -> DataFrame:
    """T1 for checked messages that lie in files: ``landed`` with the outcome columns.

    Every row has a place of its own (``LANDED_COLS`` break ties of copies), so
    copies need no counting: one of them is the earliest.  The winners of the
    batch are the earliest claim of each uid (combined map-side) and the uids
    stored before (``order_uid``), written as a table (under ``folder``);
    messages join them by uid, on a scan of each side, so AQE broadcasts a
    small batch's winners and splits the partition of a hot uid.  What the
    outcome takes from the payload is made below the join, so columns that the
    caller drops are not shuffled.
    """
    x = landed.select("*", _early(landed).alias("_early"), F.xxhash64("value").alias("_vh"))
    place = F.struct(*[F.col(c) for c in SEQ_COLS], F.col("_vh"), *[F.col(c) for c in LANDED_COLS])
    open_ = F.col("_early").isNull()
    claims = x.filter(open_ & F.col("child_error").isNull()).select("order_uid", place.alias("_seq"), F.lit(False).alias("_stored"))
    prior = stored_uids.select("order_uid", F.lit(None).cast(claims.schema["_seq"].dataType).alias("_seq"), F.lit(True).alias("_stored"))
    winners = claims.unionByName(prior).groupBy(F.col("order_uid").alias("_uid")).agg(F.min("_seq").alias("_win"), F.max("_stored").alias("_stored"))
    winners = written(winners, "winners", folder)
    key = _join_key(open_, F.concat_ws("#", *[F.col(c).cast("string") for c in LANDED_COLS]))
    p = x.withColumn("_key", key).join(winners, F.col("_key") == F.col("_uid"), "left")
    return _with_outcome(p, F.coalesce(F.col("_early"), _late(_taken(place))), landed.columns)


def _with_outcome(df: DataFrame, outcome: Column, columns: list[str]) -> DataFrame:
    return df.withColumn("_o", outcome).select(
        *columns, F.col("_o.status").alias("status"), F.col("_o.reason").alias("reason"),
        F.col("_o.error_text").alias("error_text"), F.col("_o.reason").isNotNull().alias("dead_lettered"))


# Rows of marks that are broadcast: 4 KB each, for 32,768 places of a file.
MAX_MARK_ROWS = 16_384


def taken_marks(landed: DataFrame, stored_uids: DataFrame, folder: str | None = None) -> DataFrame:
    """Step 4 for landed messages, a bit each: ``landed_file``, ``_bucket``, ``_bits``, written under ``folder``.

    A set bit says that the message's uid is stored, or claimed before it.  Only
    places, times and uids of the messages that the step decides are shuffled.
    """
    asked = landed.filter(_early(landed).isNull())
    taken = settle(asked, stored_uids, folder).filter(F.col("reason") == R_EXISTS).select(*LANDED_COLS)
    at = F.col("landed_row") + 1  # buckets are counted from 1
    bits = taken.groupBy("landed_file", F.bitmap_bucket_number(at).alias("_bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("_bits"))
    return written(bits, "taken", folder)


def settle_in_place(landed: DataFrame, marks: DataFrame) -> DataFrame:
    """``settle`` by the marks of ``taken_marks``: no payload is shuffled where the marks can be broadcast."""
    at = F.col("landed_row") + 1
    x = landed.select("*", F.bitmap_bucket_number(at).alias("_bucket"), F.bitmap_bit_position(at).alias("_bit"))
    p = x.join(bounded_broadcast(marks, MAX_MARK_ROWS), ["landed_file", "_bucket"], "left")
    byte = F.expr("cast(conv(hex(substring(_bits, cast(_bit div 8 as int) + 1, 1)), 16, 10) as int)")
    taken = F.coalesce(F.call_function("shiftright", byte, F.expr("cast(_bit % 8 as int)")).bitwiseAND(F.lit(1)) == 1, F.lit(False))
    return _with_outcome(p, F.coalesce(_early(p), _late(taken)), landed.columns)


OUTCOME_COLS = ["status", "reason", "error_text", "dead_lettered"]


def attach(messages: DataFrame, decided: DataFrame) -> DataFrame:
    """Messages (any frame with the envelope columns) with their outcomes.

    The payload is shuffled once, by message id; copies of one message are
    numbered there and take the outcomes of their numbers.
    """
    numbered = messages.withColumn("_id", message_id())
    numbered = numbered.withColumn("_copy", F.row_number().over(Window.partitionBy("_id").orderBy("offset")))
    # written as a difference, so the join's key is the id alone, by which the rows already lie
    same = (F.col("_id") == F.col("message_id")) & (F.col("_copy") - F.col("copy") == 0)
    joined = numbered.join(decided.select("message_id", "copy", *OUTCOME_COLS), same)
    return joined.select(*messages.columns, *OUTCOME_COLS)


def route(messages: DataFrame, stored_uids: DataFrame | None = None, materialize: bool = False) -> DataFrame:
    """One outcome row per message, with its payload.

    Output: the envelope, ``order``, ``order_uid``, ``decode_error``,
    ``violations`` and the outcome columns.
    """
    c = checked_messages(messages)
    return attach(c, decide(c, stored_uids, materialize))


def dead_letters(routed: DataFrame) -> DataFrame:
    """Dead-lettered messages with the reason header appended."""
    reason_header = F.struct(F.lit(schemas.DLQ_REASON_HEADER).alias("key"),
                             F.col("error_text").cast("binary").alias("value"))
    return routed.filter("dead_lettered").select(
        "key", "value",
        F.concat(F.coalesce(F.col("headers"), F.array().cast("array<struct<key:string,value:binary>>")),
                 F.array(reason_header)).alias("headers"),
        "topic", "partition", "offset", "timestamp", "reason",
    )


def outcome_counts(routed: DataFrame) -> DataFrame:
    """A2: messages by status."""
    return routed.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def dead_letter_counts(routed: DataFrame) -> DataFrame:
    """A3: dead letters by reason."""
    return routed.filter("dead_lettered").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def stored_orders(routed: DataFrame) -> DataFrame:
    """The valid messages as stored rows: the nested order plus audit times
    and the source coordinates (which make replays idempotent)."""
    return routed.filter(F.col("status") == VALID).select(
        F.col("order.*"), "topic", "partition", "offset",
        F.col("timestamp").alias("created_at"), F.col("timestamp").alias("updated_at"))


# --------------------------------------------------------------------------
# Uniqueness audits over decoded messages
# --------------------------------------------------------------------------

def duplicate_uids(checked: DataFrame) -> DataFrame:
    """Uids carried by more than one decodable message, with the count."""
    return (checked.filter("decode_ok").groupBy("order_uid")
            .agg(F.count(F.lit(1)).alias("n_messages")).filter(F.col("n_messages") > 1))


def first_message_per_uid(checked: DataFrame) -> DataFrame:
    """Earliest decodable message per uid (``min(seq)``, no window buffer)."""
    g = checked.filter("decode_ok").groupBy("order_uid").agg(F.min(seq()).alias("s"))
    return g.select("order_uid", F.col("s.partition").alias("partition"), F.col("s.offset").alias("offset"))
