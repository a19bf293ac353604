"""Registered queries that must not stop at a prefix of their table."""

import duckdb

import __spark_entry__ as entry

SF = "/root/testdata/sf0.01"


def oracle(name, sf=SF):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in ("customer", "orders"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return sorted(con.execute(entry.oracle_sql()[name]).fetchall(), key=repr)


def rows(spark, name, sf=SF):
    return sorted(map(tuple, entry.queries()[name](spark, sf).collect()), key=repr)


def test_the_whole_log_is_pulled(spark):
    got = rows(spark, "pull_batches")
    last = spark.read.parquet(f"{SF}/orders.parquet").agg({"o_orderkey": "max"}).first()[0]
    assert got == oracle("pull_batches") and len(got) > 1 and max(r[2] for r in got) == last


def test_right_join_and_clients_take_every_customer(spark):
    keys = {r[0] for r in spark.read.parquet(f"{SF}/customer.parquet").select("c_custkey").collect()}
    joined, safe, stale = (rows(spark, n) for n in ("join_right", "tombstone_safe_version", "stale_clients"))
    assert [joined, safe, stale] == [oracle(n) for n in ("join_right", "tombstone_safe_version", "stale_clients")]
    assert {r[0] for r in joined} == keys and safe == [(min(keys) * 3 + 150,)]
    assert any(r[1] <= 50 * 3 + 150 for r in stale)
