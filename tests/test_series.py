"""Paths, recently-used keys, size cap, quantiles, rates, trailing counts."""

from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from parcelry.functions.sizes import order_size
from parcelry.operators import series as ser
from parcelry.operators.documents import order_struct


def test_path_normalisation(spark):
    cases = [("/orders/12345", "/orders/:id"), ("/orders/", "/orders/:id"), ("/home", "/home"), ("/", "/"),
             ("/static/css/main.css", "/static/css/main.css")]
    df = spark.createDataFrame([(p,) for p, _ in cases], "path string")
    got = [r[0] for r in df.select(ser.normalized_path(F.col("path"))).collect()]
    assert got == [w for _, w in cases]
    uids = [r[0] for r in df.select(ser.path_order_uid(F.col("path"))).collect()]
    assert uids == ["12345", None, None, None, None]


def test_recently_used_capacity_two(spark):
    t0 = datetime(2024, 1, 1, tzinfo=timezone.utc)
    df = spark.createDataFrame([("uid1", t0), ("uid2", t0 + timedelta(seconds=1)), ("uid3", t0 + timedelta(seconds=2))],
                               "key string, ts timestamp")
    assert {r.key for r in ser.recently_used(df, 2).collect()} == {"uid2", "uid3"}


def test_size_cap_cases(spark):
    """Cap 470: a 63-char track number is over, a 5-char one is under."""
    from parcelry import schemas

    def row(uid, track):
        return {f: ("" if f not in ("sm_id", "delivery", "payment", "items", "date_created") else None)
                for f in schemas.ORDER_FIELDS} | {"order_uid": uid, "track_number": track}
    rows = [row("large", "thisisalongtracknumberthatwillmaketheordersizelargerthan10bytes"), row("small", "short")]
    df = spark.createDataFrame(rows, schemas.ORDER)
    sizes = [r[0] for r in df.select(order_size(order_struct(df))).collect()]
    assert sizes[0] > 470 >= sizes[1]
    assert sizes[1] == 450


def test_histogram_quantile_edges(spark):
    b = [1.0, 2.0]
    df = spark.createDataFrame([([0, 0, 0],), ([10, 10, 10],), ([0, 10, 10],), ([0, 0, 10],)], "cum array<bigint>")
    got = [r[0] for r in df.select(ser.histogram_quantile(0.5, F.col("cum"), b)).collect()]
    assert str(got[0]) == "nan"
    assert got[1] == 0.5           # first bucket: lower bound 0, linear inside
    assert got[2] == 1.5           # second bucket
    assert got[3] == 2.0           # +Inf bucket: highest finite bound


def test_window_rate_matches_window_function(spark):
    t0 = datetime(2024, 1, 1, tzinfo=timezone.utc)
    rows = [(t0 + timedelta(seconds=17 * i), "a" if i % 3 else "b") for i in range(200)]
    df = spark.createDataFrame(rows, "ts timestamp, k string")
    mine = {(r.window_start, r.k): r.n for r in ser.window_rate(df, "ts", ["k"]).collect()}
    ref = df.groupBy(F.window("ts", "5 minutes", "1 minute").alias("w"), "k").count()
    theirs = {(r.w.start, r.k): r["count"] for r in ref.collect()}
    assert mine == theirs


def test_trailing_count_brute_force(spark):
    t0 = datetime(2024, 1, 1, tzinfo=timezone.utc)
    rows = [(i, i % 3, t0 + timedelta(seconds=(i * 37) % 1000 + i * 0.001)) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, key long, ts timestamp")
    got = {r.id: r.n_trailing for r in ser.trailing_count(df, "key", "ts").collect()}
    for i, k, ts in rows:
        want = sum(1 for _, k2, t2 in rows if k2 == k and ts - timedelta(seconds=300) < t2 <= ts)
        assert got[i] == want


def test_counter_increase_with_reset(spark):
    t0 = datetime(2024, 1, 1, tzinfo=timezone.utc)
    vals = [5, 7, 10, 2, 4]   # reset after 10
    df = spark.createDataFrame([(1, t0 + timedelta(seconds=10 * i), float(v)) for i, v in enumerate(vals)],
                               "series long, ts timestamp, value double")
    [r] = ser.counter_increase(df).collect()
    assert r.increase == 2 + 3 + 2 + 2


def test_window_rate_for_any_range_and_step(spark):
    """Equal to Spark's own sliding windows, also where the step does not divide the range."""
    import random
    from datetime import datetime, timedelta, timezone
    rng = random.Random(1)
    t0 = datetime(2024, 1, 1, tzinfo=timezone.utc)
    df = spark.createDataFrame([(t0 + timedelta(seconds=rng.randrange(900)), rng.choice("ab")) for _ in range(200)], "ts timestamp, k string")
    for range_s, step_s in ((90, 60), (300, 60), (60, 60), (100, 35), (50, 70)):
        got = {(r.window_start, r.k): r.n for r in ser.window_rate(df, "ts", ["k"], range_s, step_s).collect()}
        if step_s <= range_s:
            w = F.window("ts", f"{range_s} seconds", f"{step_s} seconds")
            want = {(r.w.start, r.k): r.n for r in df.groupBy(w.alias("w"), "k").agg(F.count("*").alias("n")).collect()}
        else:  # windows with gaps between them
            want = {}
            for r in df.collect():
                us = int(r.ts.timestamp())
                if us % step_s < range_s:
                    key = (datetime.fromtimestamp(us - us % step_s, timezone.utc).replace(tzinfo=None), r.k)
                    want[key] = want.get(key, 0) + 1
            got = {(k[0].astimezone(timezone.utc).replace(tzinfo=None) if k[0].tzinfo else k[0], k[1]): n for k, n in got.items()}
        assert got == want, (range_s, step_s)


def test_equal_timestamps_have_one_order(spark):
    rows = [(1, i, "2024-01-01 00:00:00", float(v)) for i, v in enumerate([5, 3, 9])] + [(1, 9, "2024-01-01 00:00:10", 1.0)]
    df = spark.createDataFrame(rows, "series long, sample_id long, t string, value double").select("series", "sample_id", F.to_timestamp("t").alias("ts"), "value")
    for parts in (1, 3):
        s = df.repartition(parts)
        assert ser.counter_increase(s).first()["increase"] == 3 + 6 + 1
        assert ser.counter_irate(s).first()["irate"] == 0.1
        assert ser.latest_non_null(s.filter("sample_id < 9")).first()["value"] == 9.0
