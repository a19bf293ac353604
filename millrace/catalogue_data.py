"""The registered queries on change logs, row changes, nesting, security, vectors, reports and events, with SQL that says the same."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.change import apply as apply_
from millrace.change import clients, conflict, config, coordinator, hashing, log, mapping, tracking
from millrace.operators import dml, vectors
from millrace.operators.grouping import Entity, nest
from millrace.plans.engine import Engine
from millrace.report.report import Runner, load
from millrace.schema import defaults
from millrace.schema.diff import diff
from millrace.schema.model import Policy, Schema, Table, of_struct
from millrace.schema.security import Who, check_write, secure
from millrace.sources.scratch import shared_folder
from millrace.streaming.pull import sessions, windowed_counts

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

# A change log made of orders: the same text runs in Spark and in the oracle. Versions are unique as orders' keys are
# numbered anew; keys repeat, so rows have histories.
LOG_SQL = """
SELECT CAST(o_orderkey AS BIGINT) AS version,
  CASE WHEN o_orderkey % 3 = 0 THEN 'User' WHEN o_orderkey % 3 = 1 THEN 'Order' ELSE 'Stock' END AS table_name,
  '{"Id":' || CAST(o_custkey AS STRING) || '}' AS pk_value,
  CASE WHEN o_orderkey % 10 = 0 THEN 'delete' WHEN o_orderkey % 10 < 4 THEN 'insert' ELSE 'update' END AS operation,
  CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE '{"Id":' || CAST(o_custkey AS STRING) || ',"FullName":"Name ' || CAST(o_orderkey % 17 AS STRING) || '","Status":"' || o_orderstatus || '","Note":' || CASE WHEN o_orderkey % 7 = 0 THEN 'null' ELSE '"' || o_orderpriority || '"' END || '}' END AS payload,
  'origin' || CAST(o_orderkey % 4 AS STRING) AS origin,
  CAST(o_orderdate AS STRING) AS timestamp
FROM orders
"""
_LOG = f"WITH log AS ({LOG_SQL}) "


def change_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Engine(spark, sf_dir).sql(LOG_SQL)


def _on_log(name: str, make: Callable[[DataFrame], DataFrame], sql: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: make(change_log(spark, sf_dir))
    ORACLE_SQL[name] = _LOG + sql


def _add(name: str, make: Callable[[SparkSession, str], DataFrame], sql: str) -> None:
    QUERIES[name] = make
    ORACLE_SQL[name] = sql


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


# Log and state.
_on_log("log_batch", lambda d: log.fetch_batch(d, 400, 300).changes, "SELECT * FROM log WHERE version > 400 ORDER BY version LIMIT 300")
_on_log("log_batch_hash", lambda d: d.sparkSession.createDataFrame([((b := log.fetch_batch(d, 100, 250)).hash, b.to_version, b.has_more)], "hash string, to_version long, has_more boolean"), """
, batch AS (SELECT * FROM log WHERE version > 100 ORDER BY version LIMIT 250)
SELECT sha256(string_agg(version || ':' || table_name || ':' || pk_value || ':' || operation || ':' || coalesce(payload, 'null') || chr(10), '' ORDER BY version)) AS hash, max(version) AS to_version, (SELECT count(*) FROM log WHERE version > 100) > 250 AS has_more FROM batch""".strip())  # fmt: skip
_on_log("log_statistics", log.statistics, "SELECT max(version) AS max_version, min(version) AS min_version, count(*) AS entries FROM log")
_LAST = ", ranked AS (SELECT *, row_number() OVER (PARTITION BY table_name, pk_value ORDER BY version DESC) AS r FROM log) "
_on_log("log_materialise", log.state, _LAST.strip() + " SELECT * EXCLUDE (r) FROM ranked WHERE r = 1 AND operation <> 'delete'")
_on_log("echo_filter", lambda d: log.without_echo(d, "origin2"), "SELECT * FROM log WHERE origin <> 'origin2'")


def _pulled(d: DataFrame, size: int) -> DataFrame:
    session, seen = coordinator.Session("origin1"), []
    coordinator.pull(session, d, lambda b: seen.append((len(seen) + 1, b.from_version, b.to_version, b.has_more)), size)
    return d.sparkSession.createDataFrame(seen, "batch int, from_version long, to_version long, has_more boolean")


#: Changes in a batch; each batch is a few jobs, so their number grows with the log over this size.
WHOLE_BATCH = 10_000
_on_log("pull_batches", lambda d: _pulled(d, WHOLE_BATCH), f"""
, numbered AS (SELECT version, (row_number() OVER (ORDER BY version) - 1) // {WHOLE_BATCH} AS b, count(*) OVER () AS n FROM log WHERE version > 0)
, cut AS (SELECT b, max(version) AS to_version, (b + 1) * {WHOLE_BATCH} < any_value(n) AS has_more FROM numbered GROUP BY b)
SELECT CAST(b + 1 AS INTEGER) AS batch, coalesce(lag(to_version) OVER (ORDER BY b), 0) AS from_version, to_version, has_more FROM cut""".strip())  # fmt: skip


def _pushed(d: DataFrame) -> DataFrame:
    """The changes that push() sends, batch by batch."""
    session, sent = coordinator.Session("origin3"), []
    coordinator.push(session, d, lambda b: sent.append(b.changes), WHOLE_BATCH)
    return reduce(DataFrame.unionByName, sent, d.limit(0))


_on_log("push_own_changes", _pushed, "SELECT * FROM log WHERE origin = 'origin3'")

# Conflicts: last changes of even and of odd versions stand for two replicas.
_SIDES = ", a AS (SELECT *, row_number() OVER (PARTITION BY table_name, pk_value ORDER BY version DESC) AS r FROM log WHERE version % 2 = 0), b AS (SELECT *, row_number() OVER (PARTITION BY table_name, pk_value ORDER BY version DESC) AS r FROM log WHERE version % 2 = 1), pairs AS (SELECT a AS l, b AS m FROM a JOIN b ON a.table_name = b.table_name AND a.pk_value = b.pk_value AND a.origin <> b.origin AND a.r = 1 AND b.r = 1), won AS (SELECT unnest({}) FROM pairs) SELECT * EXCLUDE (r) FROM won"


def _pairs(d: DataFrame) -> DataFrame:
    return conflict.conflicts(log.latest(d.where("version % 2 = 0")), log.latest(d.where("version % 2 = 1")))


_on_log("conflict_lww", lambda d: conflict.resolve(_pairs(d)), _SIDES.format("CASE WHEN m.timestamp > l.timestamp OR (m.timestamp = l.timestamp AND m.version > l.version) THEN m ELSE l END").strip())
_on_log("conflict_server_wins", lambda d: conflict.resolve(_pairs(d), "server_wins"), _SIDES.format("m").strip())
_on_log("conflict_client_wins", lambda d: conflict.resolve(_pairs(d), "client_wins"), _SIDES.format("l").strip())
_on_log("conflict_custom", lambda d: conflict.resolve(_pairs(d), lambda a, b: a if a["version"] < b["version"] else b), _SIDES.format("CASE WHEN l.version < m.version THEN l ELSE m END").strip())

# Mapping.
CONFIG = config.parse(
    json.dumps(
        {
            "mappings": [
                {
                    "id": "user", "source_table": "User", "target_table": "Customer", "direction": "both", "pk_mapping": {"source_column": "Id", "target_column": "CustomerId"},
                    "column_mappings": [{"source": "FullName", "target": "Name"}, {"source": "Note", "target": "Remark"}, {"source": None, "target": "Source", "transform": "constant", "value": "app"}, {"source": "Status", "target": "Code", "transform": "lql", "lql": "concat(upper(Status), '-', left(FullName, '6'))"}, {"source": "FullName", "target": "Short", "transform": "lql", "lql": "FullName |> replace('Name ', 'n') |> lower()"}],
                },
                {
                    "id": "order", "source_table": "Order", "direction": "push", "multi_target": True,
                    "targets": [{"table": "Head", "column_mappings": [{"source": "Id", "target": "OrderId"}, {"source": "Status", "target": "State"}]}, {"table": "Audit", "column_mappings": [{"source": "Id", "target": "OrderId"}, {"source": None, "target": "EventType", "value": "seen"}]}],
                },
                {"id": "stock", "source_table": "Stock", "direction": "push", "excluded_columns": ["note", "FullName"], "filter": {"lql": "Status = 'F' or Id < 100"}, "sync_tracking": {"strategy": "hash"}},
            ]
        }
    )
)
_MAPPED = "SELECT version, {} AS target_table, {} AS target_pk, {} AS mapped_payload FROM log WHERE table_name = '{}'"
_SHOWN = ["version", "target_table", "target_pk", "mapped_payload"]


def _json(*fields: str) -> str:
    """SQL of a JSON object's text from (name, SQL of the value's JSON, or null to leave it out)."""
    return "'{' || concat_ws(',', " + ", ".join(fields) + ") || '}'"


_NAME, _STATUS, _NOTE = "'\"Name ' || CAST(version % 17 AS STRING) || '\"'", "json_extract_string(payload, '$.Status')", "json_extract(payload, '$.Note')"
_USER = _json(f"'\"Name\":' || {_NAME}", f"CASE WHEN json_extract_string(payload, '$.Note') IS NOT NULL THEN '\"Remark\":' || {_NOTE} END", "'\"Source\":\"app\"'", f"'\"Code\":\"' || upper({_STATUS}) || '-' || left('Name ' || CAST(version % 17 AS STRING), 6) || '\"'", "'\"Short\":\"n' || CAST(version % 17 AS STRING) || '\"'")
_user_sql = _MAPPED.format("'Customer'", "replace(pk_value, 'Id', 'CustomerId')", f"CASE WHEN payload IS NOT NULL THEN {_USER} END", "User")
_on_log("mapping_rename_and_expr", lambda d: mapping.apply(d.where("table_name = 'User'"), CONFIG, "push").select(*_SHOWN), _user_sql)
_head = "CASE WHEN payload IS NOT NULL THEN '{\"OrderId\":' || json_extract(payload, '$.Id') || ',\"State\":\"' || json_extract_string(payload, '$.Status') || '\"}' END"
_audit = "CASE WHEN payload IS NOT NULL THEN '{\"OrderId\":' || json_extract(payload, '$.Id') || ',\"EventType\":\"seen\"}' END"
_on_log("mapping_multi_target", lambda d: mapping.apply(d.where("table_name = 'Order'"), CONFIG, "push").select(*_SHOWN), _MAPPED.format("'Head'", "pk_value", _head, "Order") + " UNION ALL " + _MAPPED.format("'Audit'", "pk_value", _audit, "Order"))
_stock_where = " AND (payload IS NULL OR json_extract_string(payload, '$.Status') = 'F' OR CAST(json_extract_string(payload, '$.Id') AS INTEGER) < 100)"
_stock = "CASE WHEN payload IS NOT NULL THEN '{\"Id\":' || json_extract(payload, '$.Id') || ',\"Status\":\"' || json_extract_string(payload, '$.Status') || '\"}' END"
_on_log("mapping_exclude_and_filter", lambda d: mapping.apply(d.where("table_name = 'Stock'"), CONFIG, "push").select(*_SHOWN), _MAPPED.format("'Stock'", "pk_value", _stock, "Stock") + _stock_where)
_on_log("mapping_pull_strict", lambda d: mapping.apply(d, CONFIG, "pull").groupBy("mapping_id", "target_table").agg(F.count("*").alias("n")), "SELECT 'user' AS mapping_id, 'Customer' AS target_table, count(*) AS n FROM log WHERE table_name = 'User'")
_on_log("mapping_passthrough", lambda d: mapping.apply(d, config.MappingConfig(unmapped="passthrough"), "push").select(*_SHOWN), "SELECT version, table_name AS target_table, pk_value AS target_pk, payload AS mapped_payload FROM log")


def _tracked(d: DataFrame, table: str) -> DataFrame:
    spark = d.sparkSession
    state = spark.createDataFrame([("user", 600, "t", 5)], tracking.STATE)
    own = mapping.apply(d, CONFIG, "push")
    first = tracking.pending(own.where("version <= 500"), CONFIG, state, spark.createDataFrame([], tracking.HASHES))
    known = tracking.remember(spark.createDataFrame([], tracking.HASHES), first, "now")
    return tracking.pending(own.where(F.col("table_name") == table), CONFIG, state, known).select("version")


_on_log("tracking_version", lambda d: _tracked(d, "User"), "SELECT version FROM log WHERE table_name = 'User' AND version > 600")
_on_log(
    "tracking_hash",
    lambda d: _tracked(d, "Stock"),
    f""", own AS (SELECT * FROM log WHERE table_name = 'Stock'{_stock_where}),
    last AS (SELECT *, row_number() OVER (PARTITION BY pk_value ORDER BY version DESC) AS r FROM own WHERE version <= 500),
    known AS (SELECT pk_value, payload FROM last WHERE r = 1 AND operation <> 'delete')
    SELECT version FROM own LEFT JOIN known USING (pk_value) WHERE operation = 'delete' OR known.payload IS NULL OR own.payload <> known.payload""",
)
_on_log("mapping_state", lambda d: tracking.advance(d.sparkSession.createDataFrame([("user", 600, "t", 5)], tracking.STATE), mapping.apply(d, CONFIG, "pull").where("version > 600"), "now"), "SELECT 'user' AS mapping_id, max(version) AS last_synced_version, 'now' AS last_sync_timestamp, count(*) + 5 AS records_synced FROM log WHERE table_name = 'User' AND version > 600")

# Clients and subscriptions, made of customers.
_CLIENTS_SQL = "SELECT c_name AS origin_id, CAST(c_custkey * 3 + 150 AS BIGINT) AS last_sync_version, '2024-' || CASE WHEN c_custkey % 9 + 1 < 10 THEN '0' ELSE '' END || CAST(c_custkey % 9 + 1 AS STRING) || '-15T00:00:00Z' AS last_sync_timestamp, '2024-01-01T00:00:00Z' AS created_at FROM customer"
_add("tombstone_safe_version", lambda s, d: s.createDataFrame([(clients.safe_version(Engine(s, d).sql(_CLIENTS_SQL)),)], "safe long"), "SELECT CAST(min(c_custkey) * 3 + 150 AS BIGINT) AS safe FROM customer")
_add("stale_clients", lambda s, d: clients.stale(Engine(s, d).sql(_CLIENTS_SQL), "2024-09-20T12:00:00Z"), f"WITH c AS ({_CLIENTS_SQL}) SELECT * FROM c WHERE CAST(substr(last_sync_timestamp, 1, 19) AS TIMESTAMP) < TIMESTAMP '2024-09-20 12:00:00' - INTERVAL 90 DAY")
_on_log("tombstone_purge", lambda d: clients.purge(d, 700), "SELECT * FROM log WHERE NOT (operation = 'delete' AND version <= 700)")


def _notified(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = [("s1", "x", "table", "User", None, "a", None), ("s2", "y", "record", "Order", '["7","10","13"]', "a", "2030-01-01"), ("s3", "z", "query", "Stock", None, "a", "2020-01-01")]
    subscriptions = spark.createDataFrame(rows, clients.SUBSCRIPTIONS)
    return clients.notifications(change_log(spark, sf_dir), subscriptions, "2025-01-01").select("subscription_id", "version")


_add("subscription_match", _notified, _LOG + "SELECT 's1' AS subscription_id, version FROM log WHERE table_name = 'User' UNION ALL SELECT 's2', version FROM log WHERE table_name = 'Order' AND json_extract_string(pk_value, '$.Id') IN ('7', '10', '13')")


# Capture and application.
def _captured(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = _read(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    after = before.where("s_suppkey % 5 <> 0").select("s_suppkey", F.when(F.col("s_suppkey") % 7 == 0, F.concat("s_name", F.lit("!"))).otherwise(F.col("s_name")).alias("s_name"), "s_nationkey")
    after = after.unionByName(before.where("s_suppkey % 4 = 1").select((F.col("s_suppkey") + 1_000_000).alias("s_suppkey"), "s_name", "s_nationkey"))
    return log.capture(before, after, "supplier", "s_suppkey", "here", "2024-01-01")


_IMAGE = "'{\"s_name\":\"' || n || '\",\"s_nationkey\":' || s_nationkey || ',\"s_suppkey\":' || k || '}'"
_add(
    "snapshot_diff_capture",
    _captured,
    f"""WITH changes AS (
      SELECT s_suppkey AS k, 'delete' AS operation, CAST(NULL AS VARCHAR) AS payload FROM supplier WHERE s_suppkey % 5 = 0
      UNION ALL SELECT k, 'update', {_IMAGE} FROM (SELECT s_suppkey AS k, s_name || '!' AS n, s_nationkey FROM supplier) WHERE k % 5 <> 0 AND k % 7 = 0
      UNION ALL SELECT k, 'insert', {_IMAGE} FROM (SELECT s_suppkey + 1000000 AS k, s_name AS n, s_nationkey FROM supplier WHERE s_suppkey % 4 = 1))
    SELECT row_number() OVER (ORDER BY k) AS version, 'supplier' AS table_name, '{{"s_suppkey":' || k || '}}' AS pk_value, operation, payload, 'here' AS origin, '2024-01-01' AS timestamp FROM changes""",
)


def _applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    target = _read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("Id"), F.col("c_name").alias("FullName"), F.lit("old").alias("Status"), F.lit("kept").alias("Extra"))
    changes = change_log(spark, sf_dir).where("table_name = 'User'")
    return apply_.apply_changes({"User": target}, {"User": "Id"}, changes, "origin0").tables["User"]


_add(
    "apply_changes",
    _applied,
    _LOG + """, l AS (SELECT *, CAST(json_extract_string(pk_value, '$.Id') AS BIGINT) AS k, row_number() OVER (PARTITION BY pk_value ORDER BY version DESC) AS r FROM log WHERE table_name = 'User' AND origin <> 'origin0'), last AS (SELECT * FROM l WHERE r = 1)
    SELECT coalesce(k, c_custkey) AS Id, CASE WHEN k IS NULL THEN c_name ELSE json_extract_string(payload, '$.FullName') END AS FullName, CASE WHEN k IS NULL THEN 'old' ELSE json_extract_string(payload, '$.Status') END AS Status, CASE WHEN c_custkey IS NOT NULL THEN 'kept' END AS Extra
    FROM customer FULL JOIN last ON c_custkey = k WHERE coalesce(operation, '') <> 'delete'""",
)
_add("row_hash", lambda s, d: (n := _read(s, d, "nation")).select("n_nationkey", hashing.row_hash(n).alias("hash")), "SELECT n_nationkey, sha256('{\"n_name\":\"' || n_name || '\",\"n_nationkey\":' || n_nationkey || ',\"n_regionkey\":' || n_regionkey || '}') AS hash FROM nation")

# Row changes by key.
_NEW = "SELECT s_suppkey + 50 AS s_suppkey, 'new ' || s_name AS s_name, s_nationkey, s_acctbal FROM supplier"


def _changed(change: Callable[[DataFrame, DataFrame, list[str]], DataFrame], columns: list[str] | None = None) -> Callable[[SparkSession, str], DataFrame]:
    def make(spark: SparkSession, sf_dir: str) -> DataFrame:
        new = Engine(spark, sf_dir).sql(_NEW)
        return change(_read(spark, sf_dir, "supplier"), new.select(*columns) if columns else new, ["s_suppkey"])

    return make


_add("dml_insert_absent", _changed(dml.insert_absent), f"WITH n AS ({_NEW}) SELECT * FROM supplier UNION ALL SELECT * FROM n WHERE s_suppkey NOT IN (SELECT s_suppkey FROM supplier)")
_add("dml_upsert", _changed(dml.upsert), f"WITH n AS ({_NEW}) SELECT * FROM n UNION ALL SELECT * FROM supplier WHERE s_suppkey NOT IN (SELECT s_suppkey FROM n)")
_add("dml_update", _changed(dml.update, ["s_suppkey", "s_name"]), f"WITH n AS ({_NEW}) SELECT t.s_suppkey, CASE WHEN n.s_suppkey IS NULL THEN t.s_name ELSE n.s_name END AS s_name, t.s_nationkey, t.s_acctbal FROM supplier t LEFT JOIN n USING (s_suppkey)")
_add("dml_delete", _changed(dml.delete, ["s_suppkey"]), f"WITH n AS ({_NEW}) SELECT * FROM supplier WHERE s_suppkey NOT IN (SELECT s_suppkey FROM n)")


def _inserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = Engine(spark, sf_dir)
    engine.tables.register("report_table", spark.createDataFrame([(0, "first")], "id long, name string"))
    engine.query("let joined = customer |> join(orders, on = customer.c_custkey = orders.o_custkey) |> filter(fn(r) => r.orders.o_orderstatus = 'P')\njoined |> select(c_custkey as id, c_name as name) |> union(supplier |> select(s_suppkey, s_name)) |> insert(report_table)")
    return engine.query("report_table")


_add("insert_select", _inserted, "SELECT 0 AS id, 'first' AS name UNION ALL (SELECT c_custkey, c_name FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_orderstatus = 'P' UNION SELECT s_suppkey, s_name FROM supplier)")


# Nesting.
def _nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = Engine(spark, sf_dir).query("customer |> left_join(orders, on = customer.c_custkey = orders.o_custkey) |> select(c_custkey, c_name, o_orderkey, o_orderstatus)")
    own = nest(flat, Entity("customer", ("c_custkey",), ("c_custkey", "c_name")), Entity("orders", ("o_orderkey",), ("o_orderkey", "o_orderstatus")))
    return own.select("c_custkey", "c_name", F.size("orders").cast("long").alias("n"), F.array_join(F.transform("orders", lambda o: F.concat_ws(":", o["o_orderkey"].cast("string"), o["o_orderstatus"])), ",").alias("children"))


_add("parent_child_grouping", _nested, "SELECT c_custkey, any_value(c_name) AS c_name, count(*) AS n, coalesce(string_agg(concat_ws(':', o_orderkey, o_orderstatus), ',' ORDER BY o_orderkey, o_orderstatus), '') AS children FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey")

# Security.
_WHO = Who("7", frozenset({"clerk"}), {"app.nation": "12"})
_SIMPLE = (Policy("own", using="o_custkey = bigint(current_user_id())"),)
_MEMBER = (Policy("member", using="exists(customer |> filter(fn(c) => c.c_custkey = o_custkey and c.c_nationkey = current_setting('app.nation')::int))"),)
_MIXED = (
    Policy("open", using="o_orderstatus = 'O'"), Policy("mine", using="o_custkey = 7"), Policy("auditors", roles=("auditor",), using="true"), Policy("writes", operations=("insert",), using="true"),
    Policy("cheap", permissive=False, using="o_totalprice < 100000"), Policy("recent", permissive=False, using_sql="year(o_orderdate) >= 1995"),
)


def _guarded(policies: tuple[Policy, ...]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: secure(Engine(spark, sf_dir), {"orders": policies}, _WHO).query("orders |> select(o_orderkey, o_custkey)")


_add("rls_simple_predicate", _guarded(_SIMPLE), "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey = 7")
_add("rls_exists_membership", _guarded(_MEMBER), "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 12)")
_add("rls_permissive_restrictive", _guarded(_MIXED), "SELECT o_orderkey, o_custkey FROM orders WHERE (o_orderstatus = 'O' OR o_custkey = 7) AND o_totalprice < 100000 AND year(o_orderdate) >= 1995")
_add("rls_checked_write", lambda s, d: check_write(e := Engine(s, d), "orders", _SIMPLE, _WHO, e.query("orders |> filter(o_custkey = 7) |> select(o_orderkey, o_custkey)"), "insert"), "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey = 7")

# Vectors: distances of all vectors to one.
_ONE = "(SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = (SELECT min(vec_id) FROM embeddings))"


def _distances(measure: Callable) -> Callable[[SparkSession, str], DataFrame]:
    def make(spark: SparkSession, sf_dir: str) -> DataFrame:
        own = _read(spark, sf_dir, "embeddings")
        one = F.lit([float(x) for x in own.orderBy("vec_id").select("embedding").first()[0]])
        return own.select("vec_id", F.round(measure(F.col("embedding"), one), 6).alias("distance"))

    return make


_add("vector_l2", _distances(vectors.l2), f"SELECT vec_id, round(list_distance(CAST(embedding AS DOUBLE[]), {_ONE}), 6) AS distance FROM embeddings")
_add("vector_dot", _distances(vectors.dot), f"SELECT vec_id, round(list_inner_product(CAST(embedding AS DOUBLE[]), {_ONE}), 6) AS distance FROM embeddings")
_add("vector_cosine", _distances(vectors.cosine), f"SELECT vec_id, round(list_cosine_distance(CAST(embedding AS DOUBLE[]), {_ONE}), 6) AS distance FROM embeddings")

# Reports.
REPORT = load(
    json.dumps(
        {
            "id": "stock", "title": "Stock",
            "parameters": [{"name": "least", "type": "Integer", "default": "10"}, {"name": "brand", "type": "String"}],
            "dataSources": [
                {"id": "summary", "type": "Lql", "query": "part |> filter(fn(p) => p.p_size >= @least and (@brand is null or p.p_brand = @brand)) |> group_by(p_brand) |> select(p_brand as category, count(*) as items, sum(p_size) as stock)", "parameters": ["least", "brand"]},
                {"id": "totals", "type": "Sql", "query": "SELECT count(*) AS items, max(p_size) AS largest FROM part WHERE p_size >= @least", "parameters": ["least"]},
            ],
        }
    )
)
_add("report_category_summary", lambda s, d: Runner({"": Engine(s, d)}).frames(REPORT)["summary"], "SELECT p_brand AS category, count(*) AS items, sum(p_size) AS stock FROM part WHERE p_size >= 10 GROUP BY p_brand")
_add("report_totals", lambda s, d: Runner({"": Engine(s, d)}).frames(REPORT, {"least": "25"})["totals"], "SELECT count(*) AS items, max(p_size) AS largest FROM part WHERE p_size >= 25")

# Extensions: event time.
_add("events_tumbling", lambda s, d: windowed_counts(_read(s, d, "events").withColumn("value", F.round(F.col("value") * 100, 0))).withColumn("start", F.col("start").cast("timestamp_ntz")), "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, sum(round(value * 100, 0)) AS total FROM events GROUP BY 1, 2")
_add(
    "events_sessions",
    lambda s, d: sessions(_read(s, d, "events")).select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("stop").cast("timestamp_ntz").alias("stop"), "n"),
    """WITH gaps AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    numbered AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM gaps)
    SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS stop, count(*) AS n FROM numbered GROUP BY user_id, g""",
)


def _streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tumbling windows once more, from a stream that ends when it has caught up; its last state is a table in the
    folder that the cluster shares."""
    path = f"{sf_dir}/events.parquet"
    # As a pattern the path may be one file as well as a folder of files.
    events = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{sf_dir}/[e]vents.parquet").withColumn("value", F.round(F.col("value") * 100, 0))
    out = f"{shared_folder(spark)}/tumbling-{uuid.uuid4().hex}"
    writer = windowed_counts(events).writeStream.outputMode("complete").option("checkpointLocation", f"{out}-checkpoint")
    writer.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(out)).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(out).withColumn("start", F.col("start").cast("timestamp_ntz"))


_add("events_tumbling_stream", _streamed, ORACLE_SQL["events_tumbling"])

# Schemas.
_DECLARED = Table("supplier_card", ()).column("s_suppkey", "BigInt").column("s_name", "VarChar(80)").column("grade", "Int", default="3").column("note", "Text", default="upper('none')").column("s_acctbal", "Decimal(12,2)")
_add("default_fill", lambda s, d: defaults.fill(_read(s, d, "supplier").select("s_suppkey", "s_name"), _DECLARED).drop("s_acctbal"), "SELECT s_suppkey, s_name, 3 AS grade, 'NONE' AS note FROM supplier")


def _function(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = defaults.function_body("case when balance < 0 then 'debt' when balance > 5000 then 'rich' else 'fair' end")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION standing(balance DOUBLE) RETURNS STRING RETURN {body}")
    return Engine(spark, sf_dir).query("customer |> select(c_custkey, standing(c_acctbal) as standing)")


_add("function_body", _function, "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal > 5000 THEN 'rich' ELSE 'fair' END AS standing FROM customer")


def _schema_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    live = Schema("live", tuple(of_struct(t, spark.read.parquet(f"{sf_dir}/{t}.parquet").schema) for t in ("nation", "region")))
    wanted = Schema("wanted", (Table("Nation", (*live.tables[0].columns[:2], _DECLARED.columns[2])), _DECLARED))
    return spark.createDataFrame([(o.kind, o.table) for o in diff(live, wanted, destructive=True)], "kind string, table_name string")


_add("schema_diff", _schema_diff, "SELECT * FROM (VALUES ('add_column', 'Nation'), ('create_table', 'supplier_card'), ('drop_column', 'Nation'), ('drop_table', 'region')) AS v(kind, table_name)")
