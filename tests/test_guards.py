"""Size-checked broadcast, lineage cut and lag from stream progress."""

from pyspark.sql import functions as F

from parcelry.plans import guards
from parcelry.sources.tables import load
from parcelry.streaming.intake import lag_from_progress
from tests.conftest import SF_SMALL


def _is_broadcast_hinted(df):
    return "broadcast" in df._jdf.queryExecution().analyzed().toString().lower()


def test_bounded_broadcast_small_and_over_bound(spark):
    nation = load(spark, SF_SMALL, "nation")
    assert _is_broadcast_hinted(guards.bounded_broadcast(nation, 100))
    assert not _is_broadcast_hinted(guards.bounded_broadcast(nation, 10))   # 25 rows > 10


def test_large_estimate_is_never_counted(spark, monkeypatch):
    li = load(spark, SF_SMALL, "lineitem")
    monkeypatch.setattr(guards, "MAX_ESTIMATED_BYTES", 1)
    monkeypatch.setattr(guards, "row_count_at_most", lambda df, n: (_ for _ in ()).throw(AssertionError("counted")))
    assert not _is_broadcast_hinted(guards.bounded_broadcast(li, 10 ** 9))


def test_cut_lineage_keeps_rows(spark):
    df = spark.range(100).withColumn("x", F.col("id") * 2)
    cut = guards.cut_lineage(df)
    assert cut.count() == 100 and "LogicalRDD" in cut._jdf.queryExecution().analyzed().toString()


def test_lag_from_progress(spark):
    progress = {"sources": [{"endOffset": '{"orders": {"0": 10, "1": 7}}',
                             "startOffset": '{"orders": {"2": 4}}',
                             "latestOffset": '{"orders": {"0": 15, "1": 7, "2": 14, "3": 10}}'}]}
    got = {(r.topic, r.partition): r.lag for r in lag_from_progress(spark, progress).collect()}
    assert got == {("orders", 0): 5, ("orders", 1): 0, ("orders", 2): 10, ("orders", 3): 10}
