"""Every registered query equals its DuckDB oracle at sf0.001."""

import os

import duckdb

import __spark_entry__ as E
from parcelry.plans.catalog import catalog
from parcelry.plans.oracle import oracle_sql
from parcelry.sources.tables import TABLE_NAMES
from tests.conftest import SF_SMALL
from tools.oracle_check import digest


def test_all_queries_match_oracle(spark):
    con = duckdb.connect()
    for t in TABLE_NAMES:
        p = f"{SF_SMALL}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    sqls = oracle_sql()
    bad = []
    for name, fn in catalog().items():
        df = fn(spark, SF_SMALL)
        rows = [tuple(r) for r in df.collect()]
        if name not in sqls:
            continue
        cur = con.execute(sqls[name])
        orows, ocols = cur.fetchall(), [d[0] for d in cur.description]
        if sorted(df.columns) != sorted(ocols) or digest(df.columns, rows)[0] != digest(ocols, orows)[0]:
            bad.append(name)
    assert not bad


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["order_uid", "document"]
    assert df.count() > 0
