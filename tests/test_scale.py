"""What the shuffles, written tables and stores of the order part carry."""

from parcelry.plans.catalog import catalog
from tests.conftest import SF_SMALL


def _plan(df):
    conf = df.sparkSession.conf
    conf.set("spark.sql.debug.maxToStringFields", "1000")
    try:
        return df._jdf.queryExecution().executedPlan().toString()
    finally:
        conf.unset("spark.sql.debug.maxToStringFields")


def test_lines_are_shuffled_as_plain_rows(spark):
    """Items are collected after the lines' exchange, and their texts made after it."""
    plan = _plan(catalog()["items_per_order"](spark, SF_SMALL))
    above, below = plan.split("REPARTITION_BY_COL")  # parents print first
    assert "collect_list" in above and "collect_list" not in below and "TRK" not in below


def test_orders_are_joined_before_their_fields_are_made(spark):
    plan = _plan(catalog()["order_documents"](spark, SF_SMALL))
    assert plan.rindex("@example.com") < plan.index("Exchange") and plan.rindex("TRK") < plan.index("Exchange")


def test_items_of_parts_that_tie_keep_their_order(spark):
    """Equal sort keys: the part's texts decide, as in the whole item."""
    from parcelry.operators.documents import items_per_order

    rows = [(1, 1, 5, 6, 100, 3, n, s, b) for n, s, b in [("b", "9", "x"), ("a", "9", "y"), ("a", "10", "z"), ("a", "9", "x")]]
    lines = spark.createDataFrame(rows, "order_key long, line_no long, part_key long, supp_key long, price long, sale long, name string, size string, brand string")
    items = items_per_order(lines).first()["items"]
    assert [(i["name"], i["size"], i["brand"]) for i in items] == [("a", "10", "z"), ("a", "9", "x"), ("a", "9", "y"), ("b", "9", "x")]
    assert items[0].asDict() == {"chrt_id": 6, "track_number": "TRK1", "price": 100, "rid": "r1x1", "name": "a", "sale": 3, "size": "10",
                                 "total_price": 97, "nm_id": 7, "brand": "z", "status": 202}


def test_items_are_checked_once(spark):
    """The explode's own filter and the rule list do not evaluate the item rules again."""
    plan = _plan(catalog()["item_rule_failures"](spark, SF_SMALL))
    assert plan.count("items[].rid.alphanum") == 0 and plan.count("rid.alphanum") == 1


def test_message_ids_are_made_after_the_shuffles(spark):
    from parcelry.operators import outcomes as out
    from tests.helpers import envelope_df, order

    plan = _plan(out.decide(out.checked_messages(envelope_df(spark, [order()]))))
    assert "concat_ws" in plan and "concat_ws" not in plan[plan.index("Exchange"):]


def test_plain_documents_have_a_plain_schema(spark):
    """A document of every field passes by its schema text; keys that could be taken for more are quoted in it."""
    from pyspark.sql import functions as F

    from parcelry.functions.decode import PLAIN_SCHEMAS, decode_messages
    from tests.helpers import envelope_df, order

    docs = [order(), order(items=[]), order(items=None), order(sm_id="9"), {**order(), "coupon": "none"}]
    odd = order()
    del odd["customer_id"], odd["date_created"]
    docs.append({**odd, "customer_id: STRING, date_created": "x"})
    df = envelope_df(spark, docs).withColumn("plain", F.schema_of_variant(F.parse_json(F.col("value").cast("string"))).isin(*PLAIN_SCHEMAS))
    got = [(r["plain"], r["decode_error"]) for r in decode_messages(df).orderBy("offset").select("plain", "decode_error").collect()]
    assert got == [(True, None), (True, None), (False, None), (False, "schema"), (False, "unknown_field"), (False, "unknown_field")]


def test_store_files_grow_with_the_orders(spark, scratch, monkeypatch):
    """A batch of the store has files by its bytes, not a fixed number, and the same documents."""
    from parcelry.plans import catalog as cat
    from parcelry.streaming.commits import ORDERS, CommitLog

    before = cat.order_store(spark, SF_SMALL)
    monkeypatch.setattr(cat, "compact", lambda log, fan_in: None)  # the batches as they were written
    monkeypatch.setattr(cat, "STORE_FILE_BYTES", 500)
    monkeypatch.setattr(cat, "derived", lambda spark, name, sources, modules, build: (build(f"{scratch}/store"), f"{scratch}/store")[1])
    root = cat.order_store(spark, SF_SMALL)
    small, usual = (CommitLog(spark, r).latest().of(ORDERS) for r in (root, before))
    assert len(small) == cat.STORE_BATCHES and len(usual) < cat.STORE_BATCHES and min(p.files for p in small) > 4
    rows = [CommitLog(spark, r).read(ORDERS, cat.norm.STORE_SCHEMA) for r in (root, before)]
    docs = [{tuple(r) for r in cat.doc.order_documents(x).collect()} for x in rows]
    assert docs[0] == docs[1] == {tuple(r) for r in cat.doc.order_documents(cat.doc.order_facts(spark, SF_SMALL)).collect()}


def test_plain_documents_are_read_whole(spark):
    """A document of every field is read by one typed reader; what it lacks within is zero, as on the other paths."""
    import json

    from pyspark.sql import functions as F

    from parcelry.functions.decode import decode_messages
    from parcelry.operators.outcomes import checked_messages
    from tests.helpers import envelope_df, order

    base = order()
    item = base["items"][0]
    part = {k: v for k, v in item.items() if k != "brand"}
    docs = [base, order(items=[]), order(items=[None]), order(items=[item, None, part]), order(entry='N"\u00e9\n\U0001f600')]
    got = decode_messages(envelope_df(spark, docs)).orderBy("offset").select("decode_error", "order").collect()
    assert [r["decode_error"] for r in got] == [None] * 5
    zero = {k: "" if isinstance(v, str) else 0 for k, v in item.items()}
    assert [[i.asDict() for i in r["order"]["items"]] for r in got] == [
        base["items"], [], [zero], [item, zero, {**part, "brand": ""}], base["items"]]
    assert got[4]["order"]["entry"] == 'N"\u00e9\n\U0001f600'
    assert {k: got[0]["order"][k] for k in ("order_uid", "sm_id", "oof_shard")} == {k: base[k] for k in ("order_uid", "sm_id", "oof_shard")}
    assert got[0]["order"]["payment"].asDict() == base["payment"] and got[0]["order"]["delivery"].asDict() == base["delivery"]

    twice = json.dumps(base)[:-1] + ', "sm_id": 77} tail'
    again = envelope_df(spark, [base]).withColumn("value", F.lit(twice).cast("binary"))
    r = decode_messages(again).first()
    assert r["decode_ok"] and r["order"]["sm_id"] == 77

    plan = _plan(checked_messages(envelope_df(spark, docs)))
    assert "_unread" in plan and "array_sort" not in plan


def _lines(spark, rows):
    return spark.createDataFrame(rows, "order_key long, line_no long, part_key long, supp_key long, price long, sale long, name string, size string, brand string")


def test_flat_view_shuffles_its_lines_once_as_source_columns(spark):
    """The window's exchange serves the join too, and no text of an order or item is made below it."""
    before = {k: spark.conf.get(k, None) for k in ("spark.sql.autoBroadcastJoinThreshold", "parcelry.broadcast.maxRows")}
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        spark.conf.set("parcelry.broadcast.maxRows", "100")  # part is shuffled, as at scale; nation and region are not
        plan = _plan(catalog()["order_item_flat"](spark, SF_SMALL))
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    # orders and customer, lines and part, then orders and lines by order: one exchange each
    assert plan.count("Exchange hashpartitioning") == 6
    below = plan[plan.index("Exchange hashpartitioning"):]
    assert "TRK" in plan and "TRK" not in below and "@example.com" not in below and "concat(r" not in below


def test_flat_view_of_an_order_without_lines(spark):
    """Order without lines: one row whose item columns are all null, the fixed status too; lines without an order are left out."""
    from datetime import datetime

    from parcelry.operators.documents import ITEM_FLAT, order_item_flat_lines

    t = datetime(2024, 1, 1)
    headers = spark.createDataFrame([(k, 7, 10.5, t, "1-URGENT", "c", "m", "n", "r") for k in (1, 2, None)],
                                    "order_key long, o_custkey long, o_totalprice double, o_orderdate timestamp, o_orderpriority string, c_name string, c_mktsegment string, n_name string, r_name string")
    lines = _lines(spark, [(1, 2, 5, 6, 100, 3, "b", "9", "x"), (1, 1, 5, 6, 100, 3, "a", "9", "x"), (3, 1, 5, 6, 100, 3, "z", "9", "x"), (None, 1, 5, 6, 100, 3, "z", "9", "x")])
    rows = order_item_flat_lines(headers, lines).collect()
    got = sorted(((r["order_uid"], r["item_pos"], r["item_name"], r["rid"], r["status"]) for r in rows), key=str)
    assert got == [("ord1", 0, "a", "r1x1", 202), ("ord1", 1, "b", "r1x2", 202), ("ord2", None, None, None, None), (None, None, None, None, None)]
    assert all(r[c] is None for r in rows if r["order_uid"] != "ord1" for _, c in ITEM_FLAT)


def test_a_derived_table_leaves_no_shuffle_files(spark):
    """What a build has written needs its shuffles no more; the setting is as before after it."""
    import time

    from parcelry.plans.derived import derived

    def shuffled():
        found = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
        return {found.apply(i).getName() for i in range(found.size()) if found.apply(i).getName().startswith("shuffle_")}

    before, seen = shuffled(), spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None)
    path = derived(spark, "freed-test", [f"{SF_SMALL}/orders.parquet"], ["tests.test_scale"],
                   lambda own: spark.range(5000).repartition(3, "id").write.parquet(own))
    deadline = time.time() + 20
    while shuffled() - before and time.time() < deadline:
        time.sleep(0.2)
    assert not shuffled() - before and spark.read.parquet(path).count() == 5000
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) == seen


def test_store_keeps_only_its_live_parts(spark, scratch, monkeypatch):
    """The written source columns and the parts that the compaction merged are off the disk; files are zstd."""
    import glob
    import os

    import pyarrow.parquet as pq

    from parcelry.plans import catalog as cat
    from parcelry.streaming.commits import ORDERS, CommitLog

    monkeypatch.setattr(cat, "derived", lambda spark, name, sources, modules, build: (build(f"{scratch}/store"), f"{scratch}/store")[1])
    root = cat.order_store(spark, SF_SMALL)
    log = CommitLog(spark, root)
    live = log.latest().of(ORDERS)
    assert not os.path.exists(f"{root}/_facts")
    assert sorted(os.listdir(f"{root}/orders")) == sorted(p.path.split("/")[1] for p in live)
    assert log.versions() == [log.latest().version]
    found = glob.glob(f"{root}/orders/*/*.parquet")
    assert found and {pq.ParquetFile(f).metadata.row_group(0).column(0).compression for f in found} == {"ZSTD"}
