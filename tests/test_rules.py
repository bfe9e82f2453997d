"""Validation rules: the reference's domain cases plus property checks."""

import re

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from parcelry.functions import rules as R
from parcelry.operators.outcomes import checked_messages
from tests.helpers import envelope_df, order


def _violations(spark, values):
    c = checked_messages(envelope_df(spark, values)).orderBy("offset").select("violations")
    return [list(r.violations) if r.violations is not None else None for r in c.collect()]


DOMAIN = [
    ("valid", order(), []),
    ("empty uid", order(order_uid=""), ["order_uid.alphanum", "order_uid.required"]),
    ("email", order(delivery__email="invalid-email"), ["delivery.email.email"]),
    ("phone", order(delivery__phone="12345"), ["delivery.phone.e164"]),
    ("item price", order(items__0__price=-1), ["items[].price.gte0"]),
    ("no items", order(items=[]), ["items.min1"]),
    ("sm_id zero", order(sm_id=0), ["sm_id.gt0", "sm_id.required"]),
    ("amount zero is required-fail", order(payment__amount=0), ["payment.amount.required"]),
    ("negative status ok", order(items__0__status=-5), []),
    ("sale over 100", order(items__0__sale=101), ["items[].sale.lte100"]),
    ("locale underscore", order(locale="en_US"), []),
    ("locale junk", order(locale="xx_123"), ["locale.bcp47"]),
    ("currency", order(payment__currency="NOT"), ["payment.currency.iso4217"]),
    ("shardkey decimal", order(shardkey="-1.5"), []),
    ("shardkey text", order(shardkey="abc"), ["shardkey.numeric"]),
    ("newline before end", order(order_uid="abc\n"), ["order_uid.alphanum"]),
    ("zero time", order(date_created="0001-01-01T00:00:00Z"), ["date_created.required"]),
]


def test_domain_cases(spark):
    """The domain cases in one DataFrame (one plan compile, one job)."""
    got = _violations(spark, [d[1] for d in DOMAIN])
    bad = [(name, sorted(exp), g) for (name, _, exp), g in zip(DOMAIN, got) if sorted(exp) != g]
    assert not bad


def test_gibberish_not_rule_checked(spark):
    assert _violations(spark, ["not-json"]) == [None]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(alphabet="ab09+-._ \n", max_size=8), min_size=1, max_size=25))
def test_patterns_match_python_statement(spark, samples):
    """Java regex with \\z behaves as the plain-Python statement of each rule."""
    py = {
        "alphanum": lambda s: re.fullmatch(r"[a-zA-Z0-9]+", s) is not None,
        "numeric": lambda s: re.fullmatch(r"[-+]?[0-9]+(?:\.[0-9]+)?", s) is not None,
        "e164": lambda s: re.fullmatch(r"\+[1-9]?[0-9]{7,14}", s) is not None,
    }
    df = spark.createDataFrame([(s,) for s in samples], "s string")
    got = df.select("s", F.col("s").rlike(R.ALPHANUM).alias("alphanum"), F.col("s").rlike(R.NUMERIC).alias("numeric"),
                    F.col("s").rlike(R.E164).alias("e164")).collect()
    for r in got:
        for k, f in py.items():
            assert r[k] == f(r.s), (k, r.s)


def test_storage_rules(spark):
    vals = [order(sm_id=2147483648), order(payment__payment_dt=2147483648), order(locale="en-US-x-abcdefgh"),
            order(customer_id="a\u0000b"), order(items__0__price=2147483648)]
    c = checked_messages(envelope_df(spark, vals)).orderBy("offset").select("order_error", "child_error").collect()
    assert c[0].order_error.endswith("integer out of range (SQLSTATE 22003)") and c[0].order_error.startswith("inserting order")
    assert c[1].order_error is None and c[1].child_error.startswith("inserting payment")
    assert "character varying(10)" in c[2].order_error
    assert "0x00" in c[3].order_error
    assert c[4].child_error.startswith("inserting item")


EMAILS = {
    "test@gmail.com": True, "a@b.co": True, "user@localhost": False, "a@b.1": False, "a@b.c0m1": False, "a@b.c1m": True, "a@1b.com": True,
    "a.b+c@x-y.org": True, ".a@b.com": False, "a.@b.com": False, "a..b@c.com": False, "a@b..com": False, "a@b.com.": False, "a@-b.com": False,
    "a@b-.com": False, "a@.com": False, "a@b.c": True, "a@b.-c": False, "a b@c.com": False, "\"a b\"@c.com": True, "a@b@c.com": False,
    "a@b.com\n": False, "имя@почта.рф": True, "invalid-email": False, "": False, "@b.com": False, "a@": False, "a@b_c.com": False,
}


def test_email_cases(spark):
    df = spark.createDataFrame([(e,) for e in EMAILS], "s string")
    got = {r.s: r.ok for r in df.select("s", F.col("s").rlike(R.EMAIL).alias("ok")).collect()}
    assert got == EMAILS


def test_long_hostile_addresses_are_quick(spark):
    texts = ["a@" + "a." * 20_000, "a@" + "a-" * 20_000 + "!", "\"" + "\\a" * 2_000, "a" * 50_000 + "@"]
    df = spark.createDataFrame([(e,) for e in texts], "s string")
    assert [r.ok for r in df.select(F.col("s").rlike(R.EMAIL).alias("ok")).collect()] == [False] * 4
