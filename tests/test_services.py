"""Statements, transactions, security by any spelling, versions in order, numbering of text keys."""

import pytest
from pyspark.sql import functions as F

from millrace.change import apply as apply_
from millrace.change import log
from millrace.lang.errors import QueryError
from millrace.operators import dml
from millrace.plans.engine import Engine
from millrace.report.report import ReportError, Runner, load
from millrace.schema import model
from millrace.schema.security import AccessDenied, Who, secure
from millrace.sources.tables import Tables
from millrace.streaming.pull import Buffers


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture
def boats(spark):
    return spark.createDataFrame([(1, "ann", 5), (2, "ben", 7), (3, "ann", 9)], "k int, owner string, v int")


def test_statements_tell_what_they_touched(spark, boats):
    e = Engine(spark, {"boats": boats})
    assert e.execute("UPDATE boats SET v = v + 1, owner = @o WHERE k >= 2", {"o": "it's"}) == 2
    assert e.execute("UPDATE boats SET v = 0 WHERE owner = 'nobody'") == 0
    assert e.execute("DELETE FROM `Boats` WHERE v IN (SELECT max(v) FROM boats)") == 1
    assert e.execute("INSERT INTO boats (k, owner) VALUES (8, 'x'), (9, NULL)") == 2
    assert rows(e.query("boats")) == [(1, "ann", 5), (2, "it's", 8), (8, "x", None), (9, None, None)]
    for bad in ("SELECT 1", "DELETE FROM nowhere", "UPDATE boats SET nope = 1", "UPDATE boats SET v = @missing"):
        with pytest.raises(QueryError):
            e.execute(bad)
    assert e.scalar("SELECT owner FROM boats WHERE k = 1", kind=int, default=-1) == -1 and e.scalar("SELECT 1 WHERE false", default=4) == 4


POLICY = {"boats": (model.Policy("own", using="owner = current_user_id()"),)}


@pytest.mark.parametrize(
    "text",
    [
        "SELECT k FROM boats", "SELECT k FROM `boats`", "SELECT k FROM /* x */ boats", "SELECT k FROM -- x\n boats", "SELECT k FROM BOATS b", "FROM boats SELECT k", "TABLE boats", "WITH c AS (SELECT * FROM `boats`) SELECT k FROM c",
        "WITH boats AS (SELECT * FROM boats) SELECT k FROM boats", "SELECT k FROM (SELECT * FROM (TABLE `boats`))", "SELECT a.k FROM `boats` a JOIN `boats` b ON a.k = b.k", "SELECT 1 AS k WHERE EXISTS (SELECT 1 FROM `boats` WHERE owner = 'ben')", "SELECT max(k) AS k FROM boats UNION ALL SELECT k FROM `boats`",
        "SELECT (SELECT max(k) FROM `boats`) AS k",
    ],
)
def test_no_spelling_shows_other_rows(spark, boats, text):
    e = Engine(spark, {"boats": boats})
    e.query("boats").count()  # the whole table is a view of the first session
    seen = {r[0] for r in secure(e, POLICY, Who("ann")).sql(text).collect()}
    assert seen <= {1, 3}


def test_ways_around_are_refused(spark, boats, tmp_path):
    path = f"{tmp_path}/boats.parquet"
    boats.write.parquet(path)
    boats.createOrReplaceGlobalTempView("everyones")
    spark.sql("CREATE OR REPLACE TEMP VIEW side AS SELECT * FROM global_temp.everyones")
    e = secure(Engine(spark, {"boats": path}), POLICY, Who("ann"))
    for text in (f"SELECT * FROM parquet.`{path}`", "SELECT * FROM global_temp.everyones", "SELECT * FROM side", "CREATE TEMP VIEW z AS SELECT 1", f"CREATE TABLE z USING parquet LOCATION '{path}'", "SET x = 1", "INSERT INTO boats VALUES (1, 'ann', 1)"):
        with pytest.raises(Exception):  # noqa: B017
            e.sql(text).collect()
    assert rows(e.query("boats |> select(k)")) == [(1,), (3,)]
    for text in ("INSERT INTO boats VALUES (4, 'ben', 1)", "UPDATE boats SET owner = 'ben'", "DELETE FROM boats"):
        with pytest.raises(AccessDenied):
            e.execute(text)
    assert spark.read.parquet(path).count() == 3, "nothing is written"
    assert e.execute("UPDATE boats SET v = 1 WHERE owner = 'ann'") == 2 and e.execute("INSERT INTO boats VALUES (4, 'ann', 2)") == 1
    assert rows(e.query("boats |> select(k, v)")) == [(1, 1), (3, 1), (4, 2)] and spark.read.parquet(path).count() == 4


def test_transactions_are_whole(spark, boats, tmp_path):
    for name in "ab":
        boats.withColumn("owner", F.lit(name)).write.parquet(f"{tmp_path}/{name}.parquet")
    tables = Tables(spark, str(tmp_path), writable=True)

    def swap(tx):
        a, b = tx.get("a"), tx.get("b")
        tx.change("a", lambda x: x.unionByName(b))
        tx.change("b", lambda x: x.unionByName(a))
        assert tx.execute("DELETE FROM a WHERE k = 1") == 2 and tx.scalar("SELECT count(*) FROM a") == 4 and tx.query("a |> filter(k = 2)").count() == 2

    dml.transact(tables, swap)
    assert tables.get("a").count() == 4 and tables.get("b").count() == 6

    def fails(tx):
        tx.change("a", lambda x: x.limit(0))
        tx.change("b", lambda x: x.select(F.raise_error(F.lit("no")).alias("k")))

    with pytest.raises(Exception, match="no"):
        dml.transact(tables, fails)
    assert tables.get("a").count() == 4 and tables.get("b").count() == 6
    assert not [p for p in tmp_path.iterdir() if "staged" in p.name or "old" in p.name]


def test_the_last_row_given_holds(spark, boats):
    new = spark.createDataFrame([(1, "x"), (7, "y"), (1, "z"), (7, "w")], "k int, owner string")
    assert rows(dml.upsert(boats, new, ["k"]).select("k", "owner")) == [(1, "z"), (2, "ben"), (3, "ann"), (7, "w")]
    assert rows(dml.update(boats, new, ["k"]).select("k", "owner"))[0] == (1, "z")
    assert (7, "y", None) in rows(dml.insert_absent(boats, new, ["k"]))


def change(version, op, payload=None, pk=1):
    return (version, "t", f'{{"Id":{pk}}}', op, payload, "o", "")


@pytest.mark.parametrize(
    "changes, want",
    [
        ([(1, 5), (2, 3)], [(1, "1", 5)]), ([(1, 3), (2, 5), (3, 5)], [(1, "2", 5)]), ([(1, 1)], [(1, "old", 1)]), ([(1, 9), ("delete",), (3, 2), (4, 1)], [(1, "3", 2)]), ([(1, 9), ("insert", 2), (3, 4)], [(1, "3", 4)]),
        ([(1, 9), (2, None), (3, 1)], [(1, "3", 1)]), ([("delete",)], []), ([(1, 5), ("insert", 7), (3, 7)], [(1, "2", 7)]),
    ],
)
def test_versions_count_in_order(spark, changes, want):
    target = spark.createDataFrame([(1, "old", 1)], "Id int, N string, Version int")
    made = []
    for v, c in enumerate(changes, 1):
        if c[0] == "delete":
            made.append(change(v, "delete"))
        else:
            number = "null" if c[1] is None else c[1]
            made.append(change(v, "insert" if c[0] == "insert" else "update", f'{{"Id":1,"N":"{v}","Version":{number}}}'))
    got = apply_.merge(target, spark.createDataFrame(made, log.SCHEMA), "Id")
    assert rows(got) == want


def test_text_keys_are_numbered_in_ranges(spark):
    keys = [f"CUST{k:09d}" for k in range(1000)]
    df = spark.createDataFrame([(k,) for k in keys[::-1]] + [(None,)], "k string")
    got = log.numbered(df, F.col("k"), 10).orderBy("version").collect()
    assert [r.k for r in got] == [None, *keys] and [r.version for r in got] == list(range(11, 1012))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        tasks = log.numbered(df, F.col("k")).groupBy(F.spark_partition_id()).count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert len(tasks) > 1, "no one task takes all rows"


def test_batches_end_where_they_did(spark):
    d = spark.createDataFrame([change(v, "insert", "{}", v) for v in range(0, 50, 3)], log.SCHEMA)
    got = [(b.from_version, b.to_version, b.has_more, b.hash) for b in log.batches(d, 4, 4)]
    want, at = [], 4
    while (b := log.fetch_batch(d, at, 4)).to_version != at:
        want.append((b.from_version, b.to_version, b.has_more, b.hash))
        at = b.to_version
    assert got == want and list(log.batches(d, 99, 4)) == []


def test_filters_on_windows(spark, boats):
    e = Engine(spark, {"boats": boats})
    text = "boats |> filter(v > 0) |> select(k, owner, row_number() over (partition by owner order by v desc) as place) |> filter(fn(r) => r.boats.place = 1)"
    assert rows(e.query(text)) == [(2, "ben", 1), (3, "ann", 1)]
    assert e.render(text, "postgres") == "SELECT * FROM (SELECT k, owner, ROW_NUMBER() OVER (PARTITION BY owner ORDER BY v DESC) AS place FROM boats WHERE v > 0) boats WHERE place = 1"


def test_buffers():
    b = Buffers(size=2, idle=10)
    b.open("a", 0)
    assert b.offer("a", 1) and b.offer("a", 2) and b.offer("a", 3) and not b.offer("z", 1)
    assert b.take("a", 5) == [2, 3] and b.dropped["a"] == 1 and b.take("a", 6) == [] and b.clean(15) == [] and b.clean(16) == ["a"] and not b.offer("a", 1)


def test_reports_are_not_cut_unawares(spark, boats):
    report = load('{"id": "r", "dataSources": [{"id": "s", "type": "Sql", "query": "SELECT k FROM boats"}]}')
    e = {"": Engine(spark, {"boats": boats})}
    assert len(Runner(e).run(report)["s"].rows) == 3
    found = Runner(e, most=2).run(report)["s"]
    assert (len(found.rows), found.total) == (2, 3)
    with pytest.raises(ReportError, match="3 rows"):
        Runner(e, most=2).render(report, format="csv")


def test_a_broken_file_is_no_unknown_table(spark, tmp_path):
    (tmp_path / "x.parquet").write_text("no parquet")
    with pytest.raises(Exception) as e:
        Tables(spark, str(tmp_path)).get("x")
    assert not isinstance(e.value, QueryError)
    with pytest.raises(QueryError, match="Unknown table"):
        Tables(spark, str(tmp_path)).get("y")
