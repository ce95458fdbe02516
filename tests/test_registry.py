"""The registry, and a few registered queries against their SQL."""

import duckdb
import pytest

import __spark_entry__ as entry

FOLDER = "/root/testdata/sf0.001"
TABLES = "customer nation orders part supplier lineitem conversations events".split()


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["user_id", "all_bills", "active", "ending", "expired", "unknown"] and df.count() > 0


@pytest.mark.parametrize("name", ["b02_derive_deadlines", "w01_due_notices", "k01_upload_quota", "a07_evaluation_report"])
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    df = entry.queries()[name](spark, FOLDER)
    cur = con.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in cur.description]
    want = sorted(repr(dict(sorted(zip(columns, r)))) for r in cur.fetchall())
    assert sorted(repr(dict(sorted(r.asDict().items()))) for r in df.collect()) == want
