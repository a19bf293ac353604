"""More registered queries on the services around the language: statements, transactions, writes under security, exports,
replication state, schemas and tools, each with SQL that says the same."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.catalogue_data import _LOG, CONFIG, change_log
from millrace.change import apply as apply_
from millrace.change import clients, config, coordinator, errors, hashing, mapping, tracking
from millrace.change.store import Store
from millrace.functions.mapping import compile_expression, image
from millrace.lang import tree as t
from millrace.lang.lint import lint
from millrace.operators import dml
from millrace.plans.engine import Engine, statement_kind
from millrace.plans.library import Library
from millrace.plans.render import Renderer
from millrace.report.report import Runner, load
from millrace.schema import diff, model
from millrace.schema.security import AccessDenied, Who, secure
from millrace.sources import export
from millrace.sources.scratch import shared_folder
from millrace.sources.tables import Tables
from millrace.streaming.pull import Buffers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _add(name: str, make: Callable[[SparkSession, str], DataFrame], sql: str) -> None:
    QUERIES[name] = make
    ORACLE_SQL[name] = sql


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _rows(name: str, make: Callable[[SparkSession, str], list[tuple]], schema: str, sql: str) -> None:
    """A query whose few rows come from the library's own answers."""
    _add(name, lambda spark, sf_dir: spark.createDataFrame(make(spark, sf_dir), schema), sql)


def _values(columns: str, *rows: tuple) -> str:
    text = lambda v: "NULL" if v is None else str(v).upper() if isinstance(v, bool) else str(v) if isinstance(v, int | float) else "'" + v.replace("'", "''") + "'"
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(text, r)) + ')' for r in rows)}) AS v({columns})"


# Statements.
_rows("scalar_query", lambda s, d: [(Engine(s, d).scalar("SELECT max(o_totalprice) FROM orders WHERE o_orderstatus = @s", {"s": "P"}),)], "value double", "SELECT max(o_totalprice) AS value FROM orders WHERE o_orderstatus = 'P'")
_rows("scalar_other_type", lambda s, d: [(Engine(s, d).scalar("SELECT max(o_orderstatus) FROM orders", kind=int, default=0), Engine(s, d).scalar("SELECT count(*) FROM orders", kind=int, default=0))], "other long, own long", "SELECT CAST(0 AS BIGINT) AS other, count(*) AS own FROM orders")
_INSERT = "INSERT INTO supplier (s_suppkey, s_name) SELECT n_nationkey + 5000000, n_name FROM nation"
_UPDATE = "UPDATE supplier SET s_acctbal = 0.0, s_name = concat('moved ', s_name) WHERE s_nationkey < @n"
_DELETE = "DELETE FROM supplier WHERE s_suppkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)"
_COUNTS = """SELECT 1 AS step, (SELECT count(*) FROM supplier WHERE s_nationkey < 6) AS touched UNION ALL SELECT 2, (SELECT count(*) FROM supplier WHERE s_suppkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)) UNION ALL SELECT 3, (SELECT count(*) FROM nation)"""
_AFTER = """SELECT s_suppkey, CASE WHEN s_nationkey < 6 THEN 'moved ' || s_name ELSE s_name END AS s_name, s_nationkey, CASE WHEN s_nationkey < 6 THEN 0.0 ELSE s_acctbal END AS s_acctbal FROM supplier WHERE s_suppkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3) UNION ALL SELECT n_nationkey + 5000000, n_name, NULL, NULL FROM nation"""


def _memory(spark: SparkSession, sf_dir: str, *names: str) -> Engine:
    return Engine(spark, {n: _read(spark, sf_dir, n) for n in names})


def _three(on: Engine | dml.Transaction) -> list[tuple]:
    return [(k, on.execute(text, {"n": 6} if k == 1 else None)) for k, text in enumerate((_UPDATE, _DELETE, _INSERT), 1)]


def _executed(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = _memory(spark, sf_dir, "supplier", "nation", "customer")
    _three(engine)
    return engine.query("supplier")


_rows("execute_affected", lambda s, d: _three(_memory(s, d, "supplier", "nation", "customer")), "step int, touched long", _COUNTS)
_add("execute_result", _executed, _AFTER)


# Transactions.
def _scratch(spark: SparkSession, sf_dir: str, **tables: DataFrame) -> Tables:
    folder = f"{shared_folder(spark)}/tables-{uuid.uuid4().hex}"
    for name, rows in tables.items():
        rows.write.parquet(f"{folder}/{name}.parquet")
    return Tables(spark, folder, writable=True)


def _two(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two stored tables, each replaced by what both held before."""
    a, b = (_read(spark, sf_dir, x).selectExpr(f"{k} AS k", f"{n} AS n") for x, k, n in (("supplier", "s_suppkey", "s_name"), ("nation", "cast(n_nationkey AS bigint)", "n_name")))
    tables = _scratch(spark, sf_dir, a=a, b=b)

    def body(tx: dml.Transaction) -> None:
        old_a, old_b = tx.get("a"), tx.get("b")
        tx.change("a", lambda x: x.unionByName(old_b))
        tx.change("b", lambda x: x.unionByName(old_a))

    dml.transact(tables, body)
    return tables.get("a").withColumn("t", F.lit("a")).unionByName(tables.get("b").withColumn("t", F.lit("b")))


_BOTH = "SELECT s_suppkey AS k, s_name AS n FROM supplier UNION ALL SELECT CAST(n_nationkey AS BIGINT), n_name FROM nation"
_add("transaction_two_tables", _two, f"SELECT k, n, t FROM ({_BOTH}) CROSS JOIN (VALUES ('a'), ('b')) AS v(t)")


def _inside(spark: SparkSession, sf_dir: str) -> list[tuple]:
    """What execute, query and scalar see inside, and what is left after a body that raises and one that doesn't."""
    tables = _scratch(spark, sf_dir, **{n: _read(spark, sf_dir, n) for n in ("supplier", "nation", "customer")})
    seen: list[tuple] = []

    def body(tx: dml.Transaction, fails: bool) -> None:
        seen.extend(_three(tx))
        seen.append((4, tx.query("supplier |> filter(s_suppkey >= 5000000)").count()))
        seen.append((5, tx.scalar("SELECT count(*) FROM supplier")))
        if fails:
            raise RuntimeError

    try:
        dml.transact(tables, lambda tx: body(tx, True))
    except RuntimeError:
        seen = [(6, tables.get("supplier").count())]
    dml.transact(tables, lambda tx: body(tx, False))
    return [*seen, (7, tables.get("supplier").count())]


_rows("transaction_queries", _inside, "step int, touched long", f"{_COUNTS} UNION ALL SELECT 4, count(*) FROM nation UNION ALL SELECT unnest([5, 7]), count(*) FROM ({_AFTER}) UNION ALL SELECT 6, count(*) FROM supplier")

# Row changes.
_add("row_insert", lambda s, d: dml.insert(_read(s, d, "region"), s.createDataFrame([(99, "NEW")], "r_regionkey int, r_name string")), "SELECT r_regionkey, r_name FROM region UNION ALL SELECT 99, 'NEW'")
_add("bulk_insert", lambda s, d: dml.insert(_read(s, d, "supplier"), Engine(s, d).sql("SELECT c_custkey + 9000000 AS s_suppkey, c_name AS S_NAME FROM customer")), "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier UNION ALL SELECT c_custkey + 9000000, c_name, NULL, NULL FROM customer")


def _last(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = Engine(spark, sf_dir).sql("SELECT s_suppkey % 20 AS s_suppkey, concat('new ', s_name) AS s_name FROM supplier ORDER BY s_suppkey")
    return dml.upsert(_read(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), new, ["s_suppkey"])


_add("dml_upsert_last_wins", _last, "SELECT s_suppkey, s_name FROM supplier WHERE s_suppkey NOT IN (SELECT s_suppkey % 20 FROM supplier) UNION ALL SELECT s_suppkey % 20, 'new ' || arg_max(s_name, s_suppkey) FROM supplier GROUP BY s_suppkey % 20")

# Exports and reports.
_NATIONS = "SELECT n_nationkey, CASE WHEN n_nationkey % 5 = 0 THEN 'a \"b\", ' || n_name WHEN n_nationkey % 5 = 1 THEN NULL ELSE n_name END AS n_name FROM nation ORDER BY n_nationkey"


def _exported(spark: SparkSession, sf_dir: str) -> export.Result:
    return export.collect(Engine(spark, sf_dir).sql(_NATIONS))


_CELL = "CASE WHEN n_name IS NULL THEN '' WHEN contains(n_name, '\"') THEN '\"' || replace(n_name, '\"', '\"\"') || '\"' ELSE n_name END"
_rows("export_csv", lambda s, d: [(k, x) for k, x in enumerate(export.to_csv(_exported(s, d)).split("\n"))], "line long, text string", f"WITH n AS ({_NATIONS}) SELECT CAST(0 AS BIGINT) AS line, 'n_nationkey,n_name' AS text UNION ALL SELECT row_number() OVER (ORDER BY n_nationkey), n_nationkey || ',' || {_CELL} FROM n")
_rows("export_json", lambda s, d: [(export.to_json(_exported(s, d)),)], "text string", f"WITH n AS ({_NATIONS}) SELECT '{{\"columnNames\":[\"n_nationkey\",\"n_name\"],\"rows\":[' || string_agg('[' || n_nationkey || ',' || coalesce(CAST(to_json(n_name) AS VARCHAR), 'null') || ']', ',' ORDER BY n_nationkey) || '],\"totalRows\":' || count(*) || '}}' AS text FROM n")


def _written(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """All customers as distributed files, read back."""
    out, rows = f"{shared_folder(spark)}/export-{uuid.uuid4().hex}", _read(spark, sf_dir, "customer")
    if kind == "csv":
        export.write_csv(rows, out)
        return spark.read.schema(rows.schema).option("header", True).option("escape", '"').csv(out)
    export.write_json(rows, out)
    return spark.read.schema(rows.schema).json(out)


_add("export_csv_files", lambda s, d: _written(s, d, "csv"), "SELECT * FROM customer")
_add("export_json_files", lambda s, d: _written(s, d, "json"), "SELECT * FROM customer")
_REPORT = load(json.dumps({"id": "r", "title": "R", "parameters": [{"name": "least", "type": "Decimal", "required": True}], "layout": {"rows": [1]}, "customCss": "x", "dataSources": [{"id": "new", "type": "Sql", "connectionRef": "b", "query": "SELECT count(*) AS n FROM nation"}, {"id": "old", "type": "Lql", "connectionRef": "a", "query": "nation |> filter(n_regionkey >= @least) |> select(count(*) as n)"}]}))


def _connections(spark: SparkSession, sf_dir: str) -> list[tuple]:
    found = Runner({"a": Engine(spark, sf_dir), "b": Engine(spark, {"nation": _read(spark, sf_dir, "nation").where("n_nationkey < 10")})}).run(_REPORT, {"least": "2"})
    return [(k, v.rows[0][0], v.total) for k, v in found.items()]


_rows("report_connections", _connections, "id string, n long, total long", "SELECT 'new' AS id, count(*) FILTER (WHERE n_nationkey < 10) AS n, 1 AS total FROM nation UNION ALL SELECT 'old', count(*) FILTER (WHERE n_regionkey >= 2), 1 FROM nation")
_rows("report_metadata", lambda s, d: [(k, json.dumps(v)) for k, v in _REPORT.metadata().items()], "field string, value string", _values("field, value", ("id", '"r"'), ("title", '"R"'), ("parameters", '[{"name": "least", "type": "Decimal", "required": true, "default": null}]'), ("dataSources", '["new", "old"]'), ("layout", '{"rows": [1]}'), ("css", '"x"')))

# Texts of other dialects and values.
_rows("value_formatting", lambda s, d: [(k, x, Renderer(x).literal(t.Literal(v))) for k, v in enumerate((None, True, 7, "o'k", "a\\b")) for x in ("spark", "sqlite")], "n int, dialect string, text string", _values("n, dialect, text", (0, "spark", "NULL"), (0, "sqlite", "NULL"), (1, "spark", "TRUE"), (1, "sqlite", "1"), (2, "spark", "7"), (2, "sqlite", "7"), (3, "spark", "'o\\'k'"), (3, "sqlite", "'o''k'"), (4, "spark", "'a\\\\b'"), (4, "sqlite", "'a\\b'")))
_rows("union_text", lambda s, d: [(x, Engine(s).render("a |> select(k) |> union(b |> select(k) |> order_by(k) |> limit(2)) |> order_by(k)", x)) for x in ("sqlite", "postgres")], "dialect string, text string", _values("dialect, text", ("sqlite", "SELECT k FROM a UNION SELECT * FROM (SELECT k FROM b ORDER BY k LIMIT 2) ORDER BY k"), ("postgres", "SELECT k FROM a UNION (SELECT k FROM b ORDER BY k LIMIT 2) ORDER BY k")))
_add("clock_functions", lambda s, d: Engine(s, d).query("orders |> filter(o_orderdate < now() and o_orderdate < today() and o_orderdate < current_date()) |> select(o_orderkey, hour(date_add('minute', 61, o_orderdate)) as h, minute(date_add('minute', 61, o_orderdate)) as m, second(date_add('second', 7, o_orderdate)) as s)"), "SELECT o_orderkey, CAST(hour(o_orderdate + INTERVAL 61 MINUTE) AS INTEGER) AS h, CAST(minute(o_orderdate + INTERVAL 61 MINUTE) AS INTEGER) AS m, CAST(second(o_orderdate + INTERVAL 7 SECOND) AS INTEGER) AS s FROM orders")
_add("filter_on_window", lambda s, d: Engine(s, d).query("orders |> filter(o_orderstatus = 'O') |> select(o_orderkey, o_custkey, rank() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as place) |> filter(fn(r) => r.place < 3) |> order_by(o_orderkey) |> limit(50)"), "SELECT * FROM (SELECT o_orderkey, o_custkey, rank() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders WHERE o_orderstatus = 'O') WHERE place < 3 ORDER BY o_orderkey LIMIT 50")

# Security: names however they are written, and writes.
_WHO = Who("7")
_OWN = (model.Policy("own", using="o_custkey = bigint(current_user_id())"),)


def _guarded(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    return secure(Engine(spark, sf_dir), {"orders": _OWN}, _WHO).sql(text)


for _name, _text in {
    "rls_sql_quoted": "SELECT o_orderkey FROM `orders`", "rls_sql_commented": "SELECT o_orderkey FROM /* all */ orders -- of them", "rls_sql_cte": "WITH x AS (SELECT * FROM `Orders`) SELECT o_orderkey FROM x",
    "rls_sql_nested": "SELECT c_custkey AS o_orderkey FROM customer WHERE c_custkey IN (SELECT o_orderkey FROM (TABLE `orders`))",
}.items():
    _add(_name, lambda s, d, text=_text: _guarded(s, d, text), "SELECT o_orderkey FROM orders WHERE o_custkey = 7" if "nested" not in _name else "SELECT c_custkey AS o_orderkey FROM customer WHERE c_custkey IN (SELECT o_orderkey FROM orders WHERE o_custkey = 7)")


def _refused(spark: SparkSession, sf_dir: str) -> list[tuple]:
    """Ways around a policy, and writes that it forbids."""
    engine = secure(_memory(spark, sf_dir, "orders", "customer"), {"orders": _OWN}, _WHO)
    tries = {
        "path": lambda: engine.sql(f"SELECT * FROM parquet.`{sf_dir}/orders.parquet`"), "qualified": lambda: engine.sql("SELECT * FROM default.orders"), "view": lambda: engine.sql("CREATE TEMP VIEW v AS SELECT 1"),
        "insert": lambda: engine.execute("INSERT INTO orders SELECT * FROM orders UNION ALL SELECT -1, 8, 'O', 1.0, o_orderdate, '' FROM orders LIMIT 99"), "update": lambda: engine.execute("UPDATE orders SET o_custkey = 8 WHERE o_custkey = 7"),
        "delete": lambda: engine.execute("DELETE FROM orders WHERE o_custkey = 8"), "pipe": lambda: engine.query("customer |> select(c_custkey as o_orderkey, c_custkey as o_custkey) |> insert(orders)"),
    }
    out = []
    for name, attempt in tries.items():
        try:
            attempt()
            out.append((name, "passed"))
        except (AccessDenied, Exception) as e:
            out.append((name, type(e).__name__))
    return [*out, ("own update", str(engine.execute("UPDATE orders SET o_orderstatus = 'X' WHERE o_custkey = 7") == engine.sql("SELECT 1 FROM orders WHERE o_orderstatus = 'X'").count()))]


_rows("rls_refused", _refused, "way string, outcome string", _values("way, outcome", ("path", "QueryError"), ("qualified", "QueryError"), ("view", "QueryError"), ("insert", "AccessDenied"), ("update", "AccessDenied"), ("delete", "AccessDenied"), ("pipe", "AccessDenied"), ("own update", "True")))

# Expressions of mappings.
_EXPRESSIONS = {"len": "length(Name)", "some": "coalesce(Empty, Missing, Name)", "part": "substring(Name, '2', '4')", "tail": "right(Name, '3')", "day": "At |> dateFormat('yyyy-MM-dd HH:mm')", "same": "frobnicate(Name, 'x')", "bare": "Name |> trim()"}
_add(
    "mapping_expressions",
    lambda s, d: _read(s, d, "orders").select("o_orderkey", image(F.to_json(F.struct(F.concat(F.lit(" "), "o_orderpriority").alias("Name"), F.lit("").alias("Empty"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("At")))).alias("m")).select("o_orderkey", *[compile_expression(x, F.col("m")).cast("string").alias(k) for k, x in _EXPRESSIONS.items()]),
    "SELECT o_orderkey, CAST(length(p) + 1 AS VARCHAR) AS len, ' ' || p AS some, substr(' ' || p, 2, 4) AS part, right(p, 3) AS tail, strftime(o_orderdate, '%Y-%m-%d %H:%M') AS day, ' ' || p AS same, p AS bare FROM (SELECT *, o_orderpriority AS p FROM orders)",
)
_rows("mapping_length_units", lambda s, d: [tuple(s.createDataFrame([('{"A":"a\U0001f600é"}',)], "p string").select(compile_expression("length(A)", image(F.col("p")))).first())], "n int", "SELECT CAST(4 AS INTEGER) AS n")


# Replication.
def _on_log(name: str, make: Callable[[DataFrame], DataFrame], sql: str) -> None:
    _add(name, lambda spark, sf_dir: make(change_log(spark, sf_dir)), _LOG + sql)


_add("fk_orphans", lambda s, d: apply_.orphans(_read(s, d, "customer"), "c_nationkey", _read(s, d, "nation").where("n_regionkey <> 2"), "n_nationkey").select("c_custkey"), "SELECT c_custkey FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey <> 2)")


def _deferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Children come before their parents in the log; both go in."""
    nation, region = _read(spark, sf_dir, "nation"), _read(spark, sf_dir, "region")
    tables = {"nation": nation.limit(0), "region": region.limit(0)}
    entry = lambda df, name, key, first: df.select((F.col(key) + first).cast("long").alias("version"), F.lit(name).alias("table_name"), F.to_json(F.struct(F.col(key).alias("Id"))).alias("pk_value"), F.lit("insert").alias("operation"), F.to_json(F.struct("*")).alias("payload"), F.lit("o").alias("origin"), F.lit("").alias("timestamp"))
    changes = entry(nation, "nation", "n_nationkey", 1).unionByName(entry(region, "region", "r_regionkey", 1000))
    done = apply_.apply_changes(tables, {"nation": "n_nationkey", "region": "r_regionkey"}, changes, "me", (apply_.ForeignKey("nation", "n_regionkey", "region", "r_regionkey"),))
    return done.tables["nation"].join(done.tables["region"], F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")


_add("apply_deferred", _deferred, "SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey")


def _versioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Updates that carry a Version out of step with the log's order."""
    target = _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("Id"), F.lit("old").alias("Status"), F.lit(40).alias("Version"))
    return apply_.merge(target, Engine(spark, sf_dir).sql(_VERSIONED), "Id")


_VERSIONED = """SELECT CAST(o_orderkey AS BIGINT) AS version, 'User' AS table_name, '{"Id":' || CAST(o_custkey AS STRING) || '}' AS pk_value, CASE WHEN o_orderkey % 11 = 0 THEN 'insert' ELSE 'update' END AS operation,
  '{"Id":' || CAST(o_custkey AS STRING) || ',"Status":"' || CAST(o_orderkey AS STRING) || '","Version":' || CAST((o_orderkey * 7919) % 101 AS STRING) || '}' AS payload, 'o' AS origin, '' AS timestamp FROM orders"""
_add(
    "apply_versions_in_order",
    _versioned,
    """WITH RECURSIVE steps AS (SELECT o_custkey AS k, o_orderkey AS v, (o_orderkey * 7919) % 101 AS ver, o_orderkey % 11 = 0 AS whole, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM orders),
    run(k, i, status, ver) AS (SELECT c_custkey, CAST(0 AS BIGINT), 'old', CAST(40 AS BIGINT) FROM customer
      UNION ALL SELECT r.k, s.i, CASE WHEN s.whole OR s.ver > r.ver THEN CAST(s.v AS VARCHAR) ELSE r.status END, CASE WHEN s.whole OR s.ver > r.ver THEN s.ver ELSE r.ver END FROM run r JOIN steps s ON s.k = r.k AND s.i = r.i + 1)
    SELECT k AS Id, arg_max(status, i) AS Status, CAST(arg_max(ver, i) AS INTEGER) AS Version FROM run GROUP BY k""",
)


def _synced(spark: SparkSession, sf_dir: str) -> list[tuple]:
    d = change_log(spark, sf_dir)
    got, sent = coordinator.sync(coordinator.Session("origin1", pulled=500, pushed=700), d.where("version % 2 = 0"), d, lambda b: None, lambda b: None, 5_000)
    return [("pull", got.changes, got.to_version, got.batches), ("push", sent.changes, sent.to_version, sent.batches)]


_rows("sync_round", _synced, "way string, changes long, to_version long, batches long", _LOG + "SELECT 'pull' AS way, count(*) AS changes, max(version) AS to_version, CAST(ceil(count(*) / 5000) AS BIGINT) AS batches FROM log WHERE version % 2 = 0 AND version > 500 UNION ALL SELECT 'push', count(*), max(version), CAST(ceil(count(*) / 5000) AS BIGINT) FROM log WHERE origin = 'origin1' AND version > 700")
_ALL = config.MappingConfig(mappings=tuple(config.TableMapping(x.lower(), x, tracking=config.Tracking(strategy=how)) for x, how in (("User", "timestamp"), ("Order", "external"))))
_empty = lambda d, schema: d.sparkSession.createDataFrame([], schema)
_on_log("tracking_untracked", lambda d: tracking.pending(mapping.apply(d, _ALL, "push"), _ALL, d.sparkSession.createDataFrame([("user", 900, "t", 1)], tracking.STATE), _empty(d, tracking.HASHES)).select("version"), "SELECT version FROM log WHERE table_name IN ('User', 'Order')")
_on_log("carry_push", lambda d: coordinator.carry(d, CONFIG, "push", "origin3", d.sparkSession.createDataFrame([("user", 600, "t", 5)], tracking.STATE), _empty(d, tracking.HASHES), "now").changes.where("mapping_id = 'user'").select("version", "target_table"), "SELECT version, 'Customer' AS target_table FROM log WHERE origin = 'origin3' AND table_name = 'User' AND version > 600")
_on_log("carry_pull_state", lambda d: coordinator.carry(d, CONFIG, "pull", "origin3", _empty(d, tracking.STATE), _empty(d, tracking.HASHES), "now").state, "SELECT 'user' AS mapping_id, max(version) AS last_synced_version, 'now' AS last_sync_timestamp, count(*) AS records_synced FROM log WHERE origin <> 'origin3' AND table_name = 'User' AND version > 0")
_HASHED = "SELECT sha256('{{\"n_name\":\"' || n_name || '\",\"n_nationkey\":' || n_nationkey || ',\"n_regionkey\":' || n_regionkey || '}}') AS h FROM nation"
_SUMS = "SELECT count(*) AS n, " + ", ".join(f"CAST(sum(CAST('0x' || substr(h, {15 * k + 1}, 15) AS HUGEINT)) AS VARCHAR) AS s{k}" for k in range(4)) + f" FROM ({_HASHED.replace('{{', '{').replace('}}', '}')})"
_add("table_sums", lambda s, d: hashing.table_sums(_read(s, d, "nation").repartition(7)), _SUMS)
_rows("database_hash", lambda s, d: [(hashing.database_hash({"nation": _read(s, d, "nation")}),)], "hash string", f"SELECT sha256('nation:' || sha256(n || ':' || s0 || ':' || s1 || ':' || s2 || ':' || s3) || chr(10)) AS hash FROM ({_SUMS})")
_CLIENTS = "SELECT c_name AS origin_id, CAST(c_custkey AS BIGINT) AS last_sync_version, '2024-01-01T00:00:00Z' AS last_sync_timestamp, '2024-01-01T00:00:00Z' AS created_at FROM customer"
_add("resync_required", lambda s, d: clients.behind(Engine(s, d).sql(_CLIENTS), 77).select("origin_id"), "SELECT c_name AS origin_id FROM customer WHERE c_custkey < 77")
_add("client_touch", lambda s, d: clients.touch(clients.touch(Engine(s, d).sql(_CLIENTS), "Customer#000000001", 5000, "now"), "new one", 3, "later"), f"WITH c AS ({_CLIENTS}) SELECT origin_id, CASE WHEN origin_id = 'Customer#000000001' THEN 5000 ELSE last_sync_version END AS last_sync_version, CASE WHEN origin_id = 'Customer#000000001' THEN 'now' ELSE last_sync_timestamp END AS last_sync_timestamp, created_at FROM c UNION ALL SELECT 'new one', 3, 'later', 'later'")
_rows("config_round_trip", lambda s, d: [(m.id, m.source, m.direction, m.tracking.strategy, len(m.columns)) for m in config.parse(config.serialise(CONFIG)).mappings], "id string, source string, direction string, strategy string, columns int", _values("id, source, direction, strategy, columns", ("user", "User", "both", "version", 5), ("order", "Order", "push", "version", 0), ("stock", "Stock", "push", "hash", 0)))


def _stored(spark: SparkSession, sf_dir: str) -> list[tuple]:
    store = Store(spark)
    same = store.origin() == store.origin()
    store.put("_sync_clients", Engine(spark, sf_dir).sql(_CLIENTS))
    store.put("_sync_clients", [("x", 1, "t", "t")])
    session = store.session()
    session.pulled = 12
    store.save(session)
    store.put("_sync_subscriptions", [("s1", "a", "table", "t", None, "x", "2020"), ("s2", "a", "table", "t", None, "x", None)])
    return [("origin kept", int(same)), ("clients", store.get("_sync_clients").count()), ("pulled", store.session().pulled), ("expired", store.expire("2025")), ("deleted", store.delete("_sync_clients", origin_id="x"))]


_rows("store_state", _stored, "what string, n long", "SELECT 'clients' AS what, count(*) + 1 AS n FROM customer UNION ALL SELECT * FROM (VALUES ('origin kept', 1), ('pulled', 12), ('expired', 1), ('deleted', 1))")
_rows("error_kinds", lambda s, d: [(e.__name__, issubclass(e, errors.ChangeError)) for e in (errors.ForeignKeyError, errors.DeferredChangesError, errors.FullResyncRequired, errors.HashMismatch, errors.DatabaseError, errors.UnresolvedConflict)], "name string, is_change_error boolean", _values("name, is_change_error", *[(n, True) for n in ("ForeignKeyError", "DeferredChangesError", "FullResyncRequired", "HashMismatch", "DatabaseError", "UnresolvedConflict")]))


def _buffered(spark: SparkSession, sf_dir: str) -> list[tuple]:
    """A subscriber that reads late: the oldest events are dropped; one that never comes again is forgotten."""
    buffers = Buffers(size=1000, idle=3600)
    buffers.open("slow", 0)
    buffers.open("gone", 0)
    for k, r in enumerate(change_log(spark, sf_dir).where("version <= 1400").select("version").orderBy("version").toLocalIterator()):
        buffers.offer("slow", r["version"])
    buffers.touch("slow", 4000)
    forgotten = buffers.clean(4000)
    got = buffers.take("slow", 4000)
    return [("kept", len(got)), ("first", got[0]), ("last", got[-1]), ("dropped", buffers.dropped["slow"]), ("forgotten", len(forgotten))]


_rows("subscription_buffer", _buffered, "what string, n long", _LOG + ", own AS (SELECT version, row_number() OVER (ORDER BY version DESC) AS r FROM log WHERE version <= 1400) SELECT 'kept' AS what, least(count(*), 1000) AS n FROM own UNION ALL SELECT 'first', min(version) FROM own WHERE r <= 1000 UNION ALL SELECT 'last', max(version) FROM own UNION ALL SELECT 'dropped', greatest(count(*) - 1000, 0) FROM own UNION ALL SELECT 'forgotten', 1")


# Query files, checks and advice.
def _library(spark: SparkSession, sf_dir: str) -> Library:
    with tempfile.TemporaryDirectory() as folder:  # texts that only the driver reads
        (Path(folder) / "rich.sql").write_text("SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > @least AND (@nation IS NULL OR c_nationkey = @nation)")
        (Path(folder) / "named.pipe").write_text("nation |> filter(n_nationkey < @top) |> select(n_name as name, n_regionkey)")
        (Path(folder) / "drop.sql").write_text("DELETE FROM customer")
        return Library(Engine(spark, sf_dir), folder)


_add("query_file_call", lambda s, d: _library(s, d)["rich"](least=9000, nation=3), "SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal > 9000 AND c_nationkey = 3")
_rows("query_file_schema", lambda s, d: [(n, f.name, f.dataType.simpleString()) for n in ("rich", "named") for f in _library(s, d)[n].schema()], "query string, name string, type string", _values("query, name, type", ("rich", "c_custkey", "bigint"), ("rich", "c_acctbal", "double"), ("named", "name", "string"), ("named", "n_regionkey", "int")))
_rows("query_kinds", lambda s, d: [(n, q.kind, ",".join(q.parameters)) for n, q in _library(s, d).files.items()] + [("text", statement_kind("with x as (select 1) insert into t select * from x"), "")], "name string, kind string, parameters string", _values("name, kind, parameters", ("rich", "select", "least,nation"), ("named", "select", "top"), ("drop", "delete", ""), ("text", "insert", "")))
_rows("query_checks", lambda s, d: [(k, e.line, e.column) for k, x in enumerate(("nation |> select(n_name)", "nation\n|> select(nope)", "nation |> selec(n_name)", "nation |> filter(fn(n) => n.n_name = )")) for e in Engine(s, d).validate(x)], "query int, line int, place int", _values("query, line, place", (1, 2, 10), (2, 1, 10), (3, 1, 37)))
_rows("lint_advice", lambda s, d: [(a.level, a.line, a.column) for a in lint("orders|> select(frob(x), count(*))\n|> limit(3)")] + [(a.level, a.line, a.column) for a in lint("orders |> selec(x)")], "level string, line int, place int", _values("level, line, place", ("warning", 1, 5), ("info", 1, 16), ("error", 1, 10)))

# Schemas.
_YAML = "name: s\ntables:\n- name: Docs\n  columns:\n  - {name: Id, type: Uuid, isNullable: false}\n  - {name: Price, type: 'Decimal(10,2)', defaultValue: '1.50'}\n  - {name: At, type: DateTime}\n  primaryKey: {columns: [Id]}\n"
_COLUMNS = (("Docs", "Id", "string", False), ("Docs", "Price", "decimal(10,2)", True), ("Docs", "At", "timestamp_ntz", True))
_rows("schema_yaml", lambda s, d: [(x.name, f.name, f.dataType.simpleString(), f.nullable) for x in model.from_yaml(model.to_yaml(model.from_yaml(_YAML))).tables for f in x.struct()], "table_name string, name string, type string, nullable boolean", _values("table_name, name, type, nullable", *_COLUMNS))
_rows("schema_operations", lambda s, d: [(o.kind, o.sql()) for o in diff.diff(model.Schema("live", (model.Table("Docs", model.from_yaml(_YAML).tables[0].columns[:1]), model.Table("Old", ()))), model.from_yaml(_YAML), destructive=True)], "kind string, text string", _values("kind, text", ("add_column", "ALTER TABLE `Docs` ADD COLUMNS (`Price` decimal(10,2))"), ("add_column", "ALTER TABLE `Docs` ADD COLUMNS (`At` timestamp_ntz)"), ("drop_table", "DROP TABLE `Old`")))


def _migrated(spark: SparkSession, sf_dir: str) -> list[tuple]:
    """A database is made from a schema, inspected and verified, in a session of its own."""
    own, name = spark.newSession(), f"migrated_{uuid.uuid4().hex}"
    wanted = model.from_yaml(_YAML)
    own.sql(f"CREATE DATABASE {name} LOCATION '{shared_folder(spark)}/{name}'")
    try:
        own.sql(f"USE {name}")
        done = diff.migrate(own, diff.diff(diff.inspect(own), wanted))
        found = diff.inspect(own)
        return [("ran", len(done.done)), ("failed", len(done.failed)), ("tables", len(found.tables)), ("columns", len(found.tables[0].columns)), ("mismatches", len(model.verify(wanted, found))), ("left", len([o for o in diff.diff(found, wanted) if o.sql()]))]
    finally:
        own.sql(f"DROP DATABASE {name} CASCADE")


_rows("schema_migrated", _migrated, "what string, n int", _values("what, n", ("ran", 1), ("failed", 0), ("tables", 1), ("columns", 3), ("mismatches", 0), ("left", 0)))
_rows("schema_verify", lambda s, d: [(m.table, m.column, m.what) for m in model.verify(model.from_yaml(_YAML), model.Schema("l", (model.Table("Docs", (model.from_yaml(_YAML.replace("Uuid", "Int")).tables[0].columns[0], *model.from_yaml(_YAML).tables[0].columns[1:])),)))], "table_name string, name string, what string", _values("table_name, name, what", ("Docs", "Id", "type Int, not Uuid")))
