"""Routing: the consumer's cases, uniqueness order, conservation."""

from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from parcelry import schemas
from parcelry.operators import outcomes as out
from tests.helpers import envelope_rows, order


def _route(spark, rows, stored=None):
    df = spark.createDataFrame(rows, schemas.ENVELOPE)
    st = spark.createDataFrame([(u,) for u in stored], "order_uid string") if stored is not None else None
    r = out.route(df, st).orderBy("timestamp", "offset")
    return r.select("offset", "order_uid", "status", "reason", "error_text", "dead_lettered").collect()


def test_consumer_cases(spark):
    t0 = datetime(2024, 1, 1, tzinfo=timezone.utc)
    rows = envelope_rows([order(order_uid="good1"), "not-json", order(order_uid="bad1", sm_id=0),
                          order(order_uid="big1", sm_id=2147483648)], ts=t0)
    got = _route(spark, rows)
    assert [(g.status, g.reason, g.dead_lettered) for g in got] == [
        ("valid", None, False), ("invalid", None, False), ("invalid", "invalid_order", True),
        ("error", "unhandled_error", True)]
    assert got[2].error_text == "validation failed: invalid order"
    assert got[3].error_text.startswith("failed to save order: inserting order: ")


def test_first_fully_storable_wins(spark):
    t0 = datetime(2024, 1, 1, tzinfo=timezone.utc)
    rows = []
    # a rolled-back insert (bad child row) before the winner does not hold the uid
    rows += envelope_rows([order(order_uid="u1", payment__payment_dt=2147483648)], ts=t0, start_offset=0)
    rows += envelope_rows([order(order_uid="u1")], ts=t0 + timedelta(seconds=1), start_offset=1)
    rows += envelope_rows([order(order_uid="u1", payment__payment_dt=2147483648)], ts=t0 + timedelta(seconds=2), start_offset=2)
    rows += envelope_rows([order(order_uid="u1")], ts=t0 + timedelta(seconds=3), start_offset=3)
    got = _route(spark, rows)
    assert [(g.status, g.reason) for g in got] == [
        ("error", "unhandled_error"), ("valid", None), ("invalid", "already_exists"), ("invalid", "already_exists")]
    assert got[2].error_text == "failed to save order: record already exists: uid=u1"


def test_stored_before_is_already_exists(spark):
    rows = envelope_rows([order(order_uid="old1"), order(order_uid="new1")])
    got = _route(spark, rows, stored=["old1"])
    assert [(g.order_uid, g.status, g.reason) for g in got] == [
        ("old1", "invalid", "already_exists"), ("new1", "valid", None)]


def test_conservation_and_dead_letter_headers(spark):
    from parcelry.sources.messages import order_messages

    m = order_messages(spark, "/root/testdata/sf0.001")
    r = out.route(m)
    counts = {row.status: row.n for row in out.outcome_counts(r).collect()}
    n = m.count()
    assert sum(counts.values()) == n
    # every message once
    assert r.select("topic", "partition", "offset").distinct().count() == n
    d = out.dead_letters(r)
    hdr = d.select(F.element_at("headers", -1)["key"].alias("k")).distinct().collect()
    assert [h.k for h in hdr] == [schemas.DLQ_REASON_HEADER]
    # decode failures are never dead-lettered
    assert r.filter(~F.col("decode_ok") & F.col("dead_lettered")).count() == 0


def test_hot_uid_third_of_messages(spark):
    """One uid on a third of all messages: exactly one winner, the rest
    already-exists, and the executed join splits the hot partition."""
    t0 = datetime(2024, 1, 1, tzinfo=timezone.utc)
    n = 30_000
    # unique incompressible errors make the narrow rows wide enough for small skew thresholds
    i = F.col("id")
    checked = spark.range(n).select(
        F.lit("t").alias("topic"), F.lit(0).alias("partition"), i.alias("offset"), F.lit(t0).alias("timestamp"),
        F.sha2(i.cast("string"), 512).cast("binary").alias("value"), F.lit(True).alias("decode_ok"),
        F.array().cast("array<string>").alias("violations"), F.lit(None).cast("string").alias("order_error"),
        F.when(i % 3 == 2, F.concat(F.sha2(i.cast("string"), 512), F.sha2((i + n).cast("string"), 512))).alias("child_error"),
        F.when(i % 3 == 0, "hot").otherwise(F.concat(F.lit("u"), i.cast("string"))).alias("order_uid"))
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k", "spark.sql.shuffle.partitions": "16"}
    old = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        d = out.decide(checked, materialize=True).select("order_uid", "status", "reason", "error_text")
        rows = d.collect()
        plan = d._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    hot = [(r.status, r.reason) for r in rows if r.order_uid == "hot"]
    assert len(rows) == n and hot.count(("valid", None)) == 1 and hot.count(("invalid", "already_exists")) == n // 3 - 1
    assert {r.status for r in rows if r.order_uid != "hot"} == {"valid", "error"}
    assert "skew=true" in plan


def test_two_messages_of_one_identity(spark):
    """Equal coordinates: one value wins; a repeated row is one message delivered twice."""
    one = envelope_rows([order(order_uid="u1")]) * 2 + envelope_rows([order(order_uid="u1", sm_id=7)])
    got = [(r.order_uid, r.status, r.reason) for r in _route(spark, one)]
    assert sorted(got, key=str) == [("u1", "invalid", "already_exists")] * 2 + [("u1", "valid", None)]
    decided = out.decide(out.checked_messages(spark.createDataFrame(one, schemas.ENVELOPE)), materialize=True)
    assert sorted(r["copy"] for r in decided.collect()) == [1, 1, 2]


def test_outcomes_in_place_are_those_of_the_join(spark, scratch, monkeypatch):
    """Marks (a bit a message, by file) give every landed message the outcome of the join; payloads are not shuffled."""
    t0 = datetime(2024, 1, 1, tzinfo=timezone.utc)
    n, i = 80_000, F.col("id")
    landed = spark.range(n).select(
        F.lit("t").alias("topic"), F.lit(0).alias("partition"), (i % 50_000).alias("offset"), F.lit(t0).alias("timestamp"),
        F.sha2((i % 70_000).cast("string"), 256).cast("binary").alias("value"), (i % 11 != 3).alias("decode_ok"),
        F.when(i % 7 == 2, F.array(F.lit("rule"))).otherwise(F.array().cast("array<string>")).alias("violations"),
        F.when(i % 13 == 4, "order").alias("order_error"), F.when(i % 5 == 1, "child").alias("child_error"),
        F.when(i % 17 != 0, F.concat(F.lit("u"), (i % 40_000).cast("string"))).alias("order_uid"),
        F.when(i < 70_000, "a").otherwise("b").alias("landed_file"), F.when(i < 70_000, i).otherwise(i - 70_000).alias("landed_row"))
    landed.write.parquet(f"{scratch}/landed")
    landed = spark.read.parquet(f"{scratch}/landed")
    stored = spark.createDataFrame([("u5",), ("u32767",), ("u39999",)], "order_uid string")
    cols = ["landed_file", "landed_row", *out.OUTCOME_COLS]
    want = {tuple(r) for r in out.settle(landed, stored, scratch).select(*cols).collect()}
    reasons = {(r[2], r[3]) for r in want}
    assert len(want) == n and reasons == {("valid", None), ("invalid", None), ("invalid", "invalid_order"), ("error", "unhandled_error"), ("invalid", "already_exists")}
    marks = out.taken_marks(landed, stored, scratch)
    assert {(r["landed_file"], r["_bucket"]) for r in marks.collect()} == {("a", 1), ("a", 2), ("b", 1)}
    got = out.settle_in_place(landed, marks)
    assert got.columns == [*landed.columns, *out.OUTCOME_COLS]
    assert {tuple(r) for r in got.select(*cols).collect()} == want
    assert "Exchange hashpartitioning" not in got._jdf.queryExecution().executedPlan().toString()
    # more marks than may be broadcast: a join by file and place
    monkeypatch.setattr(out, "MAX_MARK_ROWS", 2)
    monkeypatch.setattr("parcelry.plans.guards._DECISIONS", {})
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold", None)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        again = out.settle_in_place(landed, marks)
        assert {tuple(r) for r in again.select(*cols).collect()} == want
        assert "SortMergeJoin" in again._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold") if before is None else spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
