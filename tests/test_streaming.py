"""Streaming intake: sink routing, replay idempotence, stream = batch."""

import json
import os
import random
import time
from collections import Counter
from datetime import datetime, timedelta, timezone

import pytest

from pyspark.sql import functions as F

from parcelry.operators import series as ser
from parcelry.operators.outcomes import checked_messages, route, settle
from parcelry import schemas
from parcelry.operators.normalize import STORE_SCHEMA
from parcelry.sources.messages import json_array_messages, message_table, order_messages
from parcelry.streaming.commits import ORDERS, CommitLog, Manifest, Part
from parcelry.streaming.compaction import compact
from parcelry.streaming.intake import IntakeSink, committed_dead_letters, committed_orders, committed_outcomes, file_source, read_landed, start_intake, windowed_rate_stream
from parcelry.streaming.metrics import ProgressLog, lag_rows, metrics
from parcelry.streaming.reads import latest_files, latest_stored_orders, lookup_files, orders_by_uid
from tests.conftest import SF_SMALL
from tests.helpers import envelope_rows, order


def _write_envelope_files(spark, df, path, n_files):
    """Cut the messages into files in seq order (offset within partition)."""
    (df.repartitionByRange(n_files, "timestamp", "partition", "offset")
       .write.mode("overwrite").parquet(path))


def _counts(df):
    return {r.status: r["count"] for r in df.groupBy("status").count().collect()}


def _run(spark, src, root, ckpt, **kw):
    start_intake(file_source(spark, src, max_files=1), root, ckpt, available_now=True, **kw).awaitTermination(600)


def test_stream_equals_batch_and_replay(spark, scratch):
    msgs = order_messages(spark, SF_SMALL)
    src = os.path.join(scratch, "in")
    _write_envelope_files(spark, msgs, src, 3)
    root, ckpt = os.path.join(scratch, "out"), os.path.join(scratch, "ckpt")
    _run(spark, src, root, ckpt)
    log = committed_outcomes(spark, root)
    stream_counts = _counts(log)

    batch = route(spark.read.parquet(src))
    assert stream_counts == _counts(batch)
    ids = ["topic", "partition", "offset"]
    assert log.select(*ids).distinct().count() == msgs.count() == log.count()
    same = log.select(*ids, "status", "reason").exceptAll(batch.select(*ids, "status", "reason"))
    assert same.count() == 0
    # Every message has a creation header, so every outcome has a latency
    assert log.filter(F.col("latency_seconds").isNull()).count() == 0
    assert log.filter(F.col("latency_seconds") <= 0).count() == 0

    stored = committed_orders(spark, root)
    n_stored = stored.count()
    assert n_stored == stream_counts["valid"]
    assert stored.select("order_uid").distinct().count() == n_stored
    assert committed_dead_letters(spark, root).count() == batch.filter("dead_lettered").count()

    # a batch replayed after its commit writes nothing, and a restarted query goes on where it stopped
    run = stored.first()["run_id"]
    before = CommitLog(spark, root).latest()
    IntakeSink(root, run)(spark.createDataFrame([], "order_uid string, stored boolean, file string"), 0)
    _run(spark, src, root, ckpt)
    assert CommitLog(spark, root).latest() == before


def _envelope(spark, uids, start=0, **changes):
    return spark.createDataFrame(envelope_rows([order(order_uid=u, **changes) for u in uids], start_offset=start), schemas.ENVELOPE)


def _uids(spark, root):
    return sorted(r["order_uid"] for r in committed_orders(spark, root).collect())


def test_new_checkpoint_on_an_old_root_loses_nothing(spark, scratch):
    src, root = os.path.join(scratch, "in"), os.path.join(scratch, "out")
    _envelope(spark, ["a1"]).coalesce(1).write.parquet(src)
    _run(spark, src, root, os.path.join(scratch, "c1"))
    src2 = os.path.join(scratch, "in2")
    _envelope(spark, ["b1", "a1"], start=5).coalesce(1).write.parquet(src2)
    _run(spark, src2, root, os.path.join(scratch, "c2"))
    assert _uids(spark, root) == ["a1", "b1"]
    log = {(r["order_uid"], r["offset"]): r["status"] for r in committed_outcomes(spark, root).collect()}
    assert log == {("a1", 0): "valid", ("b1", 5): "valid", ("a1", 6): "invalid"}


def test_state_across_batches_and_restart(spark, scratch):
    """Uids stored by earlier batches are known without reading them: also to rows that cannot be stored, and after a restart."""
    src, root, ckpt = (os.path.join(scratch, x) for x in ("in", "out", "ckpt"))
    big = 1 << 40  # a child row that does not fit: not storable, holds no uid
    steps = [(["u1", "u2"], {}, ["valid", "valid"]), (["u1", "u3"], {"items__0__chrt_id": big}, ["invalid", "error"]),
             (["u3", "u2"], {}, ["valid", "invalid"])]
    at = 0
    for n, (uids, changes, want) in enumerate(steps):
        _envelope(spark, uids, start=at, **changes).coalesce(1).write.mode("append").parquet(src)
        _run(spark, src, root, ckpt)  # a new query on the old checkpoint each time
        got = committed_outcomes(spark, root).filter(F.col("batch_id") == n).orderBy("offset").collect()
        assert [r["status"] for r in got] == want, n
        at += len(uids)
    assert _uids(spark, root) == ["u1", "u2", "u3"]


def _landed_batch(spark, messages, folder):
    """Messages landed by hand, and the rows that routing gets for them."""
    checked_messages(messages).coalesce(1).write.parquet(folder)
    rows = spark.read.parquet(folder).select("_metadata.file_path").distinct().collect()
    return spark.createDataFrame([("s1", False, None), ("s2", False, None), *[(None, None, r[0]) for r in rows]], "order_uid string, stored boolean, file string")


def test_stop_between_any_two_writes_shows_nothing(spark, scratch, monkeypatch):
    root = os.path.join(scratch, "out")
    messages = _envelope(spark, ["s1", "s1", "s2"]).unionByName(spark.createDataFrame(envelope_rows(["broken"], start_offset=9), schemas.ENVELOPE))
    batch = _landed_batch(spark, messages, os.path.join(scratch, "landed"))
    write, commit, sink = CommitLog.write_part, CommitLog.commit_batch, IntakeSink(root, "r")
    for stop_at in range(4):
        done = []

        def stopping(self, df, table):
            if len(done) == stop_at:
                raise RuntimeError("stopped")
            done.append(table)
            return write(self, df, table)

        def no_commit(self, *a):
            raise RuntimeError("stopped")

        monkeypatch.setattr(CommitLog, "write_part", stopping)
        monkeypatch.setattr(CommitLog, "commit_batch", no_commit)
        with pytest.raises(RuntimeError, match="stopped"):
            sink(batch, 0)
        assert len(done) == min(stop_at, 3)
        assert CommitLog(spark, root).latest().parts == []
        assert committed_outcomes(spark, root).count() == committed_orders(spark, root).count() == 0
    monkeypatch.setattr(CommitLog, "write_part", write)
    monkeypatch.setattr(CommitLog, "commit_batch", commit)
    sink(batch, 0)
    sink(batch, 0)  # a replay after the commit
    assert _uids(spark, root) == ["s1", "s2"]
    assert _counts(committed_outcomes(spark, root)) == {"valid": 2, "invalid": 2}
    assert committed_dead_letters(spark, root).count() == 1
    log = CommitLog(spark, root)
    assert len(log.vacuum(older_than_s=0)) == 6  # 0 + 1 + 2 + 3 folders of stopped tries
    assert _uids(spark, root) == ["s1", "s2"]
    # A2, A3: the counts taken while writing equal the outcome log's
    seen = {r["name"]: r["value"] for r in metrics(spark, root).collect()}
    assert seen["outcomes"] == 4 and seen["status=valid"] == 2 and seen["status=invalid"] == 2 and seen["reason=already_exists"] == 1


def test_hot_uid_is_split_in_the_sink(spark, scratch):
    """A uid with a third of all messages: its join partition is one of several tasks."""
    rows = envelope_rows([order(order_uid="hot" if i % 3 == 0 else f"u{i}") for i in range(600)])
    checked_messages(spark.createDataFrame(rows, schemas.ENVELOPE)).repartition(4).write.parquet(f"{scratch}/landed")
    files = [r[0] for r in spark.read.parquet(f"{scratch}/landed").select("_metadata.file_path").distinct().collect()]
    small = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2k",
             "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5"}
    before = {k: spark.conf.get(k, None) for k in small}
    try:
        for k, v in small.items():
            spark.conf.set(k, v)
        settled = settle(read_landed(spark, files), spark.createDataFrame([], "order_uid string")).select("order_uid", "status", "value")
        got = Counter((r.order_uid == "hot", r.status) for r in settled.collect())
        assert got == {(True, "valid"): 1, (True, "invalid"): 199, (False, "valid"): 400}
        assert "skew=true" in settled._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def test_lag_and_observed_counts_per_trigger(spark, scratch):
    """T4: a listener keeps lag and observed values of every trigger; lag rows follow the original's rules."""
    progress = {"sources": [{"startOffset": {"orders": {"0": 5}}, "endOffset": '{"orders": {"0": 9, "1": -1}}', "latestOffset": {"orders": {"0": 12, "1": 4, "2": 7}}},
                            {"startOffset": None, "endOffset": {"logOffset": 3}, "latestOffset": None}]}
    assert sorted(lag_rows(progress)) == [("orders", 0, 3), ("orders", 1, 4), ("orders", 2, 7)]
    src, root = f"{scratch}/in", f"{scratch}/out"
    for n in range(2):
        _envelope(spark, [f"m{n}a", f"m{n}b"], start=2 * n).coalesce(1).write.mode("append").parquet(src)
    spark.createDataFrame(envelope_rows(["broken"], start_offset=9), schemas.ENVELOPE).coalesce(1).write.mode("append").parquet(src)
    listener = ProgressLog(spark, root)
    spark.streams.addListener(listener)
    try:
        _run(spark, src, root, f"{scratch}/ckpt")
        deadline = time.time() + 20
        while time.time() < deadline:  # progress events come on a thread of their own
            seen = metrics(spark, root).filter("name = 'landed.messages'").agg(F.sum("value")).first()[0]
            if seen == 5:
                break
            time.sleep(0.5)
    finally:
        spark.streams.removeListener(listener)
    by_name = {r["name"]: r["v"] for r in metrics(spark, root).groupBy("name").agg(F.sum("value").alias("v")).collect()}
    assert by_name["landed.messages"] == 5 and by_name["landed.undecodable"] == 1
    log = committed_outcomes(spark, root)
    assert by_name["outcomes"] == log.count() == 5
    for status, n in _counts(log).items():
        assert by_name[f"status={status}"] == n


def test_two_writers_never_share_a_version(spark, scratch):
    a, b = CommitLog(spark, scratch), CommitLog(spark, scratch)
    part = lambda name: Part(ORDERS, name, 1, 1, 1)
    raced = []

    def change(m):
        if not raced:
            raced.append(1)
            b.commit_batch("other", 0, [part("orders/b")])
        return None if m.has("mine", 0) else Manifest(m.version, {**m.runs, "mine": 0}, [*m.parts, part("orders/a")])

    got = a.commit(change)
    assert got.version == 2 and {p.path for p in got.parts} == {"orders/a", "orders/b"}
    assert got.runs == {"mine": 0, "other": 0}


def test_unreadable_store_fails_the_start(spark, scratch):
    src, root = os.path.join(scratch, "in"), os.path.join(scratch, "out")
    _envelope(spark, ["k1"]).coalesce(1).write.parquet(src)
    _run(spark, src, root, os.path.join(scratch, "c1"))
    for folder, _, names in os.walk(os.path.join(root, "orders")):
        for n in names:
            with open(os.path.join(folder, n), "wb") as f:
                f.write(b"broken" if n.endswith(".parquet") else b"")
    with pytest.raises(Exception, match="(?i)parquet|magic|corrupt|read"):
        _run(spark, src, root, os.path.join(scratch, "c2"))


def _facts(spark, uids, times, batch):
    """Stored rows with given uids and times."""
    rows = [(u, t, batch) for u, t in zip(uids, times)]
    d = spark.createDataFrame(rows, "order_uid string, updated_at timestamp, batch_id long")
    names = {f.name for f in d.schema.fields}
    return d.select(*[F.col(f.name) if f.name in names else F.lit(None).cast(f.dataType).alias(f.name) for f in STORE_SCHEMA.fields])


def test_compaction_lookup_and_latest(spark, scratch):
    """Files grow with bytes, not with batches; a read during a swap sees one version; lookups and latest-N leave files out."""
    rng = random.Random(3)
    log = CommitLog(spark, scratch)
    t0 = datetime(2024, 1, 1, tzinfo=timezone.utc)
    rows = []
    for b in range(33):
        uids = [f"u{rng.randrange(10 ** 9):09d}" for _ in range(40)]
        times = [None if rng.random() < 0.02 and b < 3 else t0 + timedelta(hours=b, seconds=rng.randrange(900)) for _ in uids]
        rows += list(zip(uids, times))
        part = log.write_part(_facts(spark, uids, times, b), ORDERS)
        log.commit_batch("r", b, [part])
        if b % 5 == 4:
            before = log.latest()
            old_read = log.read(ORDERS, STORE_SCHEMA)
            compact(log, fan_in=4, target_bytes=60_000)
            assert old_read.count() == len(rows) == log.read(ORDERS, STORE_SCHEMA).count()
            assert log.read(ORDERS, STORE_SCHEMA, before).count() == len(rows)
    parts = log.latest().of(ORDERS)
    assert len(parts) <= 8 and sum(p.rows for p in parts) == len(rows)
    assert sum(p.files for p in parts) <= 12 + sum(p.bytes for p in parts) / 30_000
    assert sorted(map(tuple, log.read(ORDERS, STORE_SCHEMA).select("order_uid", "batch_id").collect()))[0][0] == min(u for u, _ in rows)

    wanted = [u for u, _ in rng.sample(rows, 3)] + ["none", "u"]
    got = orders_by_uid(spark, scratch, wanted)
    assert sorted(r.order_uid for r in got.collect()) == sorted(u for u, _ in rows if u in wanted)
    assert "In(order_uid" in got._jdf.queryExecution().executedPlan().toString()
    chosen = lookup_files(log, wanted[:1])
    per_file = [f for p in parts for f in log.file_stats(p)]
    assert set(chosen) == {f["path"] for f in per_file if f["low"] <= wanted[0] <= f["high"]}
    assert len(chosen) < len(per_file)
    assert orders_by_uid(spark, scratch, ["zzz"]).count() == 0 and lookup_files(log, ["zzz"]) == []

    order_of = lambda r: (r[1] is not None, -(r[1].timestamp() if r[1] else 0), r[0])
    for n in (1, 5, 25, 41, 200, len(rows), len(rows) + 5):
        want = [u for u, _ in sorted(rows, key=order_of)[:n]]
        assert [r.order_uid for r in latest_stored_orders(spark, scratch, n).collect()] == want, n
    assert len(latest_files(log, 25)) < len(per_file)


def test_files_read_for_latest_do_not_grow(spark, scratch):
    log, seen = CommitLog(spark, scratch), []
    t0 = datetime(2024, 1, 1, tzinfo=timezone.utc)
    for b in range(12):
        rows = [f"b{b:03d}x{i}" for i in range(5)]
        log.commit_batch("r", b, [log.write_part(_facts(spark, rows, [t0 + timedelta(minutes=10 * b + i) for i in range(5)], b), ORDERS)])
        seen.append(len(latest_files(log, 7)))
    assert max(seen) == 2


def test_windowed_rate_stream_finalises_by_watermark(spark, scratch):
    """Append mode: only windows that the watermark has passed come out, each once, with the batch's counts."""
    src = os.path.join(scratch, "events")
    ev = spark.read.parquet(f"{SF_SMALL}/events.parquet").select(
        F.col("ts").cast("timestamp").alias("ts"), "event_type")
    ev.orderBy("ts").coalesce(1).write.option("maxRecordsPerFile", 400).parquet(src)
    stream = spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 1).parquet(src)
    agg = windowed_rate_stream(stream, "ts", ["event_type"])
    q = agg.writeStream.outputMode("append").format("memory").queryName("rates_t").start()
    q.processAllAvailable()
    q.stop()
    rows = spark.table("rates_t").collect()
    got = {(r.window_start, r.event_type): r.n for r in rows}
    want = {(r.window_start, r.event_type): r.n for r in ser.window_rate(ev, "ts", ["event_type"]).collect()}
    assert len(got) == len(rows) and 0 < len(got) < len(want)
    assert all(want[k] == n for k, n in got.items())


def _in_order(text):
    """The elements by one decoder that reads from the front."""
    def fail(name):
        raise ValueError(name)

    decoder, space, found = json.JSONDecoder(parse_constant=fail), " \t\r\n", []
    skip = lambda i: i + len(text[i:]) - len(text[i:].lstrip(space))
    at = skip(0)
    if text[at:at + 1] != "[":
        return found
    at = skip(at + 1)
    while at < len(text) and text[at] != "]":
        try:
            end = decoder.raw_decode(text, at)[1]
        except ValueError:
            break
        found.append(text[at:end])
        at = skip(end)
        if text[at:at + 1] != ",":
            break
        at = skip(at + 1)
    return found


def test_json_array_source(spark, scratch):
    """Files cut at every few bytes give the elements that one decoder gives."""
    d = os.path.join(scratch, "arr")
    os.makedirs(d)
    texts = ['[{"order_uid": "a1"}, {"order_uid":"a2","items":[]} ]', '[{"order_uid": "b1"}, {"broken": ', "not an array", "", "[]", " [ ] ", '[1, "x"\n , null',
             "[1, NaN, 2]", '[-Infinity]', '[1 2, 3]', "[1, 2}, 3]", '[1, {"a": 2], 3]', "[1,]", "[1,,2]", '{"a": [1, 2]}', "[1] , 2]", '["a,b", "\\"],[", "\\\\", "q"]',
             '["' + "x," * 300 + '", 5]', "   ", "[[[1,2],[3,{\"k\":[4,5]}]], 6]", '["\\,", 1]', '["é,漢", "\\u00e9"]', "[" + ",".join(f'{{"id":{i},"t":"a,b]{{"}}' for i in range(60)) + "]",
             '["open, 1, 2', "[1e5, 01, 2]", '["tab\there"]', "]1,2[", '[{"a":1},{"a":2}]tail,[3]']
    rng = random.Random(11)
    for _ in range(25):
        cut = json.dumps([rng.choice([1, "a,]b", {"k": [1, {"z": ","}]}, [], None, "\\\""]) for _ in range(rng.randrange(1, 12))])
        i = rng.randrange(len(cut))
        texts.append(cut[:i] + rng.choice(["", ",", "]", "}", '"', "\\", "x"]) + cut[i + rng.randrange(2):])
    for i, text in enumerate(texts):
        with open(os.path.join(d, f"{i:03d}.json"), "w", encoding="utf-8") as f:
            f.write(text)
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for size in ("150", "7000"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "1")
            rows = json_array_messages(spark, d).orderBy("file", "offset").collect()
            got = {}
            for r in rows:
                got.setdefault(int(os.path.basename(r.file)[:3]), []).append(bytes(r.value).decode())
            want = {i: e for i, e in ((i, _in_order(t)) for i, t in enumerate(texts)) if e}
            assert got == want
            assert len({(r.topic, r.partition, r.offset) for r in rows}) == len(rows)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_message_table_sees_new_input(spark, scratch):
    for t in ("orders", "customer", "nation", "region", "lineitem", "part"):
        spark.read.parquet(f"{SF_SMALL}/{t}.parquet").write.parquet(f"{scratch}/{t}.parquet")
    n = message_table(spark, scratch).count()
    assert message_table(spark, scratch).count() == n
    extra = spark.read.parquet(f"{SF_SMALL}/orders.parquet").limit(1).withColumn("o_orderkey", F.lit(10 ** 9).cast("long"))
    extra.select(spark.read.parquet(f"{scratch}/orders.parquet").columns).write.mode("append").parquet(f"{scratch}/orders.parquet")
    assert message_table(spark, scratch).count() == n + 1
