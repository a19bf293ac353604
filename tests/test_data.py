import hashlib
import json

import pytest
from pyspark.sql import functions as F

from millrace.change import apply as apply_
from millrace.change import clients, config, conflict, coordinator, errors, hashing, log, mapping, tracking
from millrace.functions.mapping import compile_expression, date_pattern, image
from millrace.operators import dml, vectors
from millrace.operators.grouping import Entity, nest
from millrace.plans.engine import Engine
from millrace.report.report import ReportError, Runner, load
from millrace.schema import defaults, diff, model, types
from millrace.schema.security import AccessDenied, Who, check_write, secure
from millrace.sources import export
from millrace.sources.tables import Tables
from millrace.streaming.pull import fan_out, pull_stream


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def entry(version, op="insert", pk=1, payload=None, table="t", origin="a", at="2024-01-01"):
    return (version, table, json.dumps({"Id": pk}), op, payload if op != "delete" else None, origin, at)


def make(spark, *entries):
    return spark.createDataFrame(list(entries), log.SCHEMA)


IMAGE = json.dumps({"Name": " Ann Bee ", "Age": 31, "Ok": True, "At": "2024-03-05T10:20:30+02:00", "None": None, "In": {"x": 1}, "Empty": ""})


@pytest.mark.parametrize(
    "text, want",
    [
        ("Age", "31"), ("name", " Ann Bee "), ("Missing", None), ("upper(Name)", " ANN BEE "), ("Name |> trim() |> lower()", "ann bee"), ("length(Name)", 9), ("concat(Age, '-', Missing, Name)", "31- Ann Bee "),
        ("coalesce(Empty, Missing, 'z')", "z"), ("substring(Name, 2, 3)", "Ann"), ("substring(Name, 0, 4)", " Ann"), ("substring(Name, 99)", ""), ("substring(Name, 'x')", None), ("substring(Empty, 1)", None),
        ("replace(Name, 'Bee', 'Sea')", " Ann Sea "), ("left(Name, 4)", " Ann"), ("right(Name, 4)", "Bee "), ("left(Name, 'q')", " Ann Bee "), ("At |> dateFormat('yyyy-MM-dd HH:mm')", "2024-03-05 08:20"),
        ("dateFormat(Name, 'yyyy')", " Ann Bee "), ("frob(Name, 'x')", " Ann Bee "), ("upper(concat('a', trim(Name)))", "AANN BEE"), ("In", '{"x":1}'),
    ],
)
def test_mapping_expressions(spark, text, want):
    df = spark.createDataFrame([(IMAGE,)], "p string").select(image(F.col("p")).alias("m"))
    assert df.select(compile_expression(text, F.col("m"))).first()[0] == want


def test_date_patterns():
    assert date_pattern("yyyy-MM-dd'T'HH:mm:ss.fff tt") == "yyyy-MM-dd'T'HH:mm:ss.SSS a"


def test_batches(spark):
    d = make(spark, *[entry(v, payload='{"Id":1}') for v in (3, 1, 7, 5, 9)])
    b = log.fetch_batch(d, 1, 2)
    assert sorted(r.version for r in b.changes.collect()) == [3, 5] and (b.from_version, b.to_version, b.has_more) == (1, 5, True)
    want = "".join(f'{v}:t:{{"Id": 1}}:insert:{{"Id":1}}\n' for v in (3, 5))
    assert b.hash == hashlib.sha256(want.encode()).hexdigest()
    last = log.fetch_batch(d, 7, 2)
    assert (last.to_version, last.has_more) == (9, False) and log.fetch_batch(d, 9, 2).to_version == 9
    assert [x.to_version for x in log.batches(d, 0, 2)] == [3, 7, 9]
    assert tuple(log.statistics(d).first()) == (9, 1, 5)


def test_state_and_conflicts(spark):
    d = make(spark, entry(1, payload="a"), entry(2, "update", payload="b"), entry(3, pk=2, payload="c"), entry(4, "delete", pk=2))
    assert [(r.version, r.payload) for r in log.state(d).collect()] == [(2, "b")]
    local = make(spark, entry(5, payload="l", origin="a", at="2024-01-02"), entry(6, pk=3, origin="a"))
    remote = make(spark, entry(4, payload="r", origin="b", at="2024-01-02"), entry(9, pk=3, origin="a"))
    pairs = conflict.conflicts(local, remote)
    assert pairs.count() == 1
    win = lambda s: conflict.resolve(pairs, s).first().payload
    assert (win("last_write_wins"), win("server_wins"), win("client_wins"), win(lambda a, b: b)) == ("l", "r", "l", "r")
    with pytest.raises(Exception, match="chose no change"):
        win(lambda a, b: None)
    with pytest.raises(ValueError):
        win("nobody")


def test_capture(spark):
    before = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id int, n string")
    after = spark.createDataFrame([(1, "a"), (2, "B"), (4, None)], "id int, n string")
    got = log.capture(before, after, "t", "id", "me", "now", 10)
    assert [(r.version, r.operation, r.pk_value, r.payload) for r in sorted(got.collect())] == [(11, "update", '{"id":2}', '{"id":2,"n":"B"}'), (12, "delete", '{"id":3}', None), (13, "insert", '{"id":4}', '{"id":4,"n":null}')]
    assert log.capture(before, after, "t", "id", "me", "now", suppressed=True).count() == 0


CONFIG = {
    "mappings": [
        {"id": "m", "source_table": "t", "target_table": "T2", "direction": "both", "pk_mapping": {"source_column": "Id", "target_column": "Key"},
         "column_mappings": [{"source": "A", "target": "B"}, {"source": "Gone", "target": "C"}, {"source": None, "target": "K", "transform": "constant", "value": "k"}, {"source": None, "target": "N", "transform": "constant"}, {"source": "A", "target": "U", "transform": "lql", "lql": "upper(A)"}, {"source": "A", "target": "E", "transform": "lql", "lql": " "}]},
        {"id": "off", "source_table": "x", "enabled": False}, {"source_table": "bad"},
        {"id": "two", "source_table": "y", "multi_target": True, "targets": [{"table": "p", "column_mappings": [{"source": "A", "target": "Z"}]}, {"table": "q"}]},
        {"id": "ex", "source_table": "z", "excluded_columns": ["SECRET"], "filter": {"lql": "A > 1 and Flag = true"}, "sync_tracking": {"strategy": "hash"}},
    ]
}


def test_mapping(spark):
    c = config.parse(json.dumps(CONFIG))
    assert config.parse(config.serialise(c)) == c and len(c.mappings) == 4 and c.mappings[0].tracking.strategy == "version"
    d = make(
        spark, entry(1, payload='{"A":"x","Id":1}'), entry(2, "delete"), entry(3, table="x", payload="{}"), entry(4, table="y", payload='{"A":1.5}'), entry(5, table="z", payload='{"A":2,"Secret":1,"Flag":true,"B":null}'),
        entry(6, table="z", payload='{"A":1,"Flag":true}'), entry(7, table="w", payload="{}"), entry(8, "delete", table="z"),
    )
    got = {(r.version, r.target_table): (r.target_pk, r.mapped_payload) for r in mapping.apply(d, c, "push").collect()}
    assert set(got) == {(1, "T2"), (2, "T2"), (4, "p"), (4, "q"), (5, "z"), (8, "z")}
    assert got[(1, "T2")][0] == '{"Key":1}' and json.loads(got[(1, "T2")][1]) == {"B": "x", "K": "k", "N": None, "U": "X", "E": "x"}
    assert got[(2, "T2")][1] is None and json.loads(got[(4, "p")][1]) == {"Z": 1.5} and json.loads(got[(5, "z")][1]) == {"A": 2, "Flag": True, "B": None}
    assert {r.version for r in mapping.apply(d, c, "pull").collect()} == {1, 2}
    assert mapping.apply(d, config.MappingConfig(unmapped="passthrough"), "push").count() == 8
    with pytest.raises(errors.DatabaseError):
        mapping.apply(d, config.MappingConfig(mappings=(config.TableMapping("m", "t", multi_target=True),)), "push")
    with pytest.raises(ValueError):
        config.parse("[]")


def test_tracking(spark):
    c = config.parse(json.dumps(CONFIG))
    none = spark.createDataFrame([], tracking.HASHES)
    state = spark.createDataFrame([("m", 1, "t", 4)], tracking.STATE)
    d = make(spark, entry(1, payload='{"A":"x"}'), entry(2, "update", payload='{"A":"y"}'), entry(3, table="z", payload='{"A":2,"Flag":true}'), entry(4, "update", table="z", payload='{"Flag":true,"A":2}'))
    first = coordinator.carry(d, c, "push", "a", state, none, "now")
    assert sorted(r.version for r in first.changes.collect()) == [2, 3, 4]
    assert {tuple(r) for r in first.state.collect()} == {("m", 2, "now", 5), ("ex", 4, "now", 2)}
    assert first.hashes.count() == 2
    again = coordinator.carry(d.where("version >= 3"), c, "push", "a", first.state, first.hashes, "later")
    assert again.changes.count() == 0, "the same image in another key order has the same hash"
    assert coordinator.carry(d, c, "pull", "a", state, none, "now").changes.count() == 0


def test_canonical_text_and_hashes(spark):
    df = spark.createDataFrame([('{"b": [1, 2], "a": "q\\"u", "c": null}',), (None,)], "p string")
    assert [r[0] for r in df.select(hashing.canonical_text(F.col("p"))).collect()] == ['{"a":"q\\"u","b":[1,2],"c":null}', None]
    a = spark.range(50).withColumn("x", F.col("id") * 2)
    assert hashing.table_hash(a) == hashing.table_hash(a.repartition(7).select("x", "id")) != hashing.table_hash(a.where("id > 0"))
    assert hashing.database_hash({"b": a, "a": a}) == hashing.database_hash({"a": a, "b": a})
    with pytest.raises(errors.HashMismatch):
        hashing.verify("x", "y")


def test_apply(spark):
    parent = spark.createDataFrame([(1, "p")], "Id int, Name string")
    child = spark.createDataFrame([], "Id int, ParentId int, Name string")
    tables, keys, fk = {"P": parent, "C": child}, {"P": "Id", "C": "Id"}, (apply_.ForeignKey("C", "ParentId", "P", "Id"),)
    d = make(spark, entry(1, pk=5, table="C", payload='{"Id":5,"ParentId":2,"Name":"c"}', origin="b"), entry(2, pk=2, table="P", payload='{"Id":2,"Name":"late"}', origin="b"), entry(3, "delete", pk=1, table="P", origin="b"), entry(4, pk=9, table="P", payload='{"Id":9,"Name":"echo"}', origin="me"))
    done = apply_.apply_changes(tables, keys, d, "me", fk)
    assert rows(done.tables["P"]) == [(2, "late")] and rows(done.tables["C"]) == [(5, 2, "c")] and (done.applied, done.skipped) == (3, 1)
    with pytest.raises(errors.DeferredChangesError) as e:
        apply_.apply_changes(tables, keys, d.where("version = 1"), "me", fk)
    assert e.value.count == 1
    versioned = spark.createDataFrame([(1, "old", 5), (2, "old", 5)], "Id int, N string, Version int")
    d = make(spark, entry(1, "update", payload='{"Id":1,"N":"stale","Version":5}'), entry(2, "update", pk=2, payload='{"Id":2,"N":"new","Version":6}'))
    assert rows(apply_.merge(versioned, d, "Id")) == [(1, "old", 5), (2, "new", 6)]


def test_coordinator(spark):
    d = make(spark, *[entry(v, payload="{}", origin="b" if v % 2 else "me") for v in range(1, 8)])
    session, seen = coordinator.Session("me"), []

    def take(batch):
        assert session.suppressed
        seen.append(batch.to_version)
        if len(seen) == 2:
            raise errors.DatabaseError("no")

    with pytest.raises(errors.DatabaseError):
        coordinator.pull(session, d, take, 3)
    assert session.pulled == 3 and not session.suppressed, "the cursor stays where the last good batch ended"
    got, sent = coordinator.sync(session, d, d, lambda b: None, lambda b: None, 3)
    assert (got.batches, got.changes, session.pulled) == (2, 4, 7) and (sent.changes, session.pushed) == (3, 6)


def test_clients(spark):
    c = spark.createDataFrame([("a", 5, "2024-01-01T00:00:00Z", "x"), ("b", 9, "2024-06-01T00:00:00Z", "x")], clients.CLIENTS)
    assert clients.safe_version(c) == 5 and clients.safe_version(c.limit(0)) == 0
    assert [r.origin_id for r in clients.stale(c, "2024-06-10T00:00:00Z").collect()] == ["a"]
    assert rows(clients.touch(c, "n", 1, "now"))[-1] == ("n", 1, "now", "now") and clients.touch(c, "a", 7, "now").where("origin_id = 'a'").first().last_sync_version == 7
    d = make(spark, entry(1), entry(2, "delete"), entry(6, "delete"), entry(7, table="u", pk="k"))
    assert sorted(r.version for r in clients.purge(d, 5).collect()) == [1, 6, 7] and clients.purge(d, 0).count() == 4
    with pytest.raises(errors.FullResyncRequired):
        clients.check_resync(3, 4)
    s = spark.createDataFrame([("s1", "x", "Table", "t", None, "a", None), ("s2", "y", "Record", "u", '["k"]', "a", "2030"), ("s3", "z", "Query", "t", None, "a", "2020")], clients.SUBSCRIPTIONS)
    assert sorted((r.subscription_id, r.version) for r in clients.notifications(d, s, "2025").collect()) == [("s1", 1), ("s1", 2), ("s1", 6), ("s2", 7)]


def test_streams(spark, tmp_path):
    folder, seen, told = f"{tmp_path}/log", [], []
    make(spark, entry(1, origin="b"), entry(2, origin="me")).write.parquet(folder)
    run = lambda: pull_stream(spark, folder, "me", lambda df, i: seen.extend(r.version for r in df.collect()), f"{tmp_path}/check").awaitTermination(60)
    run()
    make(spark, entry(3, origin="b")).write.mode("append").parquet(folder)
    run()
    assert seen == [1, 3]
    s = spark.createDataFrame([("s1", "x", "table", "t", None, "a", None)], clients.SUBSCRIPTIONS)
    fan_out(spark, folder, s, lambda df, i: told.extend(r.version for r in df.collect()), f"{tmp_path}/fan", lambda: "2025").awaitTermination(60)
    assert sorted(told) == [1, 2, 3]


def test_row_changes(spark, tmp_path):
    t = spark.createDataFrame([(1, "a", 1.0), (2, "b", None)], "k int, n string, v double")
    new = spark.createDataFrame([(2, "B"), (3, "C"), (3, "C")], "k int, n string")
    assert rows(dml.insert_absent(t, new, ["k"])) == [(1, "a", 1.0), (2, "b", None), (3, "C", None)]
    assert rows(dml.upsert(t, new, ["k"])) == [(1, "a", 1.0), (2, "B", None), (3, "C", None)]
    assert rows(dml.update(t, new.where("k = 2"), ["k"])) == [(1, "a", 1.0), (2, "B", None)]
    assert rows(dml.delete(t, new, ["k"])) == [(1, "a", 1.0)] and dml.insert(t, new).count() == 5
    t.write.parquet(f"{tmp_path}/t.parquet")
    tables = Tables(spark, {"t": f"{tmp_path}/t.parquet"})
    assert dml.execute(tables, "t", lambda x: dml.upsert(x, new, ["k"])) == 2 and rows(tables.get("t"))[-1] == (3, "C", None)
    with pytest.raises(RuntimeError):
        dml.transact(tables, lambda tx: (tx.change("t", lambda x: x.limit(0)), (_ for _ in ()).throw(RuntimeError())))
    assert tables.get("t").count() == 3
    dml.transact(tables, lambda tx: tx.change("t", lambda x: x.where("k = 1")))
    assert rows(tables.get("t")) == [(1, "a", 1.0)]


def test_nesting_and_vectors(spark):
    flat = spark.createDataFrame([(1, "a", 2, "y"), (1, "a", 1, "x"), (2, "b", None, None)], "p int, pn string, c int, cn string")
    got = {r.p: [tuple(x) for x in r.kids] for r in nest(flat, Entity("p", ("p",), ("p", "pn")), Entity("kids", ("c",), ("c", "cn"))).collect()}
    assert got == {1: [(1, "x"), (2, "y")], 2: [(None, None)]}
    v = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<float>, b array<float>").select(vectors.dot(F.col("a"), F.col("b")), vectors.l2(F.col("a"), F.col("b")), vectors.cosine(F.col("a"), F.col("b"))).collect()
    assert tuple(v[0]) == (24.0, pytest.approx(2**0.5), pytest.approx(0.04)) and v[1][2] is None


def test_export_and_report(spark):
    r = export.Result(["a", "b"], [[1, 'x,"y"'], [None, "l\nm"], [True, 1.5]], 3)
    assert export.to_csv(r) == 'a,b\n1,"x,""y"""\n,"l\nm"\ntrue,1.5'
    assert export.to_json(r) == '{"columnNames":["a","b"],"rows":[[1,"x,\\"y\\""],[null,"l\\nm"],[true,1.5]],"totalRows":3}'
    e = Engine(spark, {"products": spark.createDataFrame([("p1", "A", 5), ("p2", "B", 50)], "id string, cat string, stock int")})
    raw = {"id": "r", "title": "R", "parameters": [{"name": "least", "type": "Integer", "required": True}], "dataSources": [{"id": "s", "type": "Sql", "query": "SELECT id FROM products WHERE stock >= @least"}, {"id": "l", "type": "Lql", "query": "products |> select(cat, stock) |> filter(stock < @least)"}], "layout": {"rows": []}}
    report = load(json.dumps(raw))
    out = Runner({"db": e}).render(report, {"least": "10"}, "csv")
    assert out == {"s": "id\np2", "l": "cat,stock\nA,5"} and "query" not in json.dumps(report.metadata())
    for change, values in (({}, {}), ({}, {"least": "x"}), ({"dataSources": [{"id": "a", "type": "Api"}]}, {"least": 1}), ({"dataSources": [{"id": "a", "type": "Sql", "query": "SELEC", "connectionRef": "db"}]}, {"least": 1}), ({"dataSources": [{"id": "a", "type": "Sql", "query": "x", "connectionRef": "no"}]}, {"least": 1})):
        with pytest.raises(ReportError):
            Runner({"db": e}).run(load(json.dumps(raw | change)), values)
    with pytest.raises(ReportError):
        load("{}")


YAML = """
name: example
tables:
- name: Docs
  columns:
  - {name: Id, type: Uuid, isNullable: false}
  - {name: Owner, type: VarChar(40)}
  - {name: Price, type: "Decimal(10,2)", defaultValue: "1.50"}
  - {name: Kind, type: "Enum(kind:a|b)"}
  - {name: Vec, type: Vector(3)}
  - {name: At, type: DateTime}
  primaryKey: {columns: [Id]}
  foreignKeys:
  - {columns: [Owner], referencedTable: Users, referencedColumns: [Id]}
  rowLevelSecurity:
    enabled: true
    policies:
    - {name: own, usingLql: "Owner = current_user_id()"}
"""


def test_schema():
    s = model.from_yaml(YAML)
    assert model.from_yaml(model.to_yaml(s)) == s
    struct = s.tables[0].struct()
    assert [f.dataType.simpleString() for f in struct] == ["string", "string", "decimal(10,2)", "string", "array<float>", "timestamp_ntz"] and not struct["Id"].nullable
    assert model.of_struct("Docs", struct).columns[3].type == types.Portable("Enum", ("kind", "a", "b"))
    assert len(types.TABLE) == 30 and types.parse("nonsense(3)") == types.Portable("Text") and types.parse("nvarchar(max)").postgres() == "TEXT" and types.parse("decimal(9,1)").postgres() == "NUMERIC(9,1)"
    live = model.Schema("live", (model.Table("docs", s.tables[0].columns[:2] + (model.Column("Old", types.parse("Int")),)), model.Table("Extra", ())))
    kinds = [o.kind for o in diff.diff(live, s)]
    assert kinds.count("add_column") == 4 and "enable_security" in kinds and "create_policy" in kinds and not any(k.startswith("drop") for k in kinds)
    assert [o.kind for o in diff.diff(live, s, destructive=True) if o.kind.startswith("drop")] == ["drop_column", "drop_table"]
    assert diff.diff(s, s) == []
    assert [(m.column, m.what) for m in model.verify(s, model.Schema("l", (model.Table("Docs", (model.Column("Id", types.parse("Int")), *s.tables[0].columns[1:])),)))] == [("Id", "type Int, not Uuid")]


def test_migration(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS migrated")
    spark.sql("USE migrated")
    try:
        spark.sql("DROP TABLE IF EXISTS Docs")
        s = model.from_yaml(YAML)
        plan = diff.diff(diff.inspect(spark), s)
        assert diff.migrate(spark, plan, dry_run=True).done == []
        assert diff.migrate(spark, plan).failed == [] and model.verify(s, diff.inspect(spark)) == []
        wider = model.Schema("w", (s.tables[0].column("More", "Int"),))
        more = [o for o in diff.diff(diff.inspect(spark), wider) if o.sql()]
        assert [o.kind for o in more] == ["add_column"] and not diff.migrate(spark, more).failed
        assert len(diff.migrate(spark, more, go_on=True).failed) == 1
    finally:
        spark.sql("DROP TABLE IF EXISTS Docs")
        spark.sql("USE default")
        spark.sql("DROP DATABASE migrated CASCADE")


def test_defaults(spark):
    assert [defaults.translate(x) for x in ("now()", "'a b'", "true", "1.5", "gen_uuid()", "upper('x')")] == ["current_timestamp()", "'a b'", "TRUE", "1.5", "uuid()", "`upper`('x')"]
    t = model.Table("t", ()).column("a", "Int").column("b", "Text", default="'z'").column("c", "Double")
    assert rows(defaults.fill(spark.createDataFrame([(1,)], "A int"), t)) == [(1, "z", None)]
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION twice(x INT) RETURNS INT RETURN {defaults.function_body('x * 2')}")
    assert spark.sql("SELECT twice(4)").first()[0] == 8


def test_security(spark):
    docs = spark.createDataFrame([("d1", "u1", "g1"), ("d2", "u2", "g1"), ("d3", "u2", "g2")], "Id string, OwnerId string, GroupId string")
    member = spark.createDataFrame([("u1", "g2")], "UserId string, GroupId string")
    e = Engine(spark, {"Docs": docs, "Member": member})
    own = model.Policy("own", using="OwnerId = current_user_id()")
    group = model.Policy("group", operations=("select",), using="exists(Member |> filter(fn(m) => m.UserId = current_user_id() and m.GroupId = Docs.GroupId))")
    strict = model.Policy("strict", permissive=False, using="GroupId = current_setting('app.g')::text")
    seen = lambda policies, who: sorted(r.Id for r in secure(e, {"Docs": policies}, who).query("Docs |> select(Id)").collect())
    assert seen((own, group), Who("u1")) == ["d1", "d3"] and seen((own, group, strict), Who("u1", settings={"app.g": "g1"})) == ["d1"]
    assert seen((model.Policy("r", roles=("boss",), using="true"),), Who("u1")) == [] and seen((own,), Who(None)) == []
    assert seen((model.Policy("q", using="OwnerId = current_user_id()"),), Who("u1' or '1'='1")) == []
    assert check_write(e, "Docs", (own,), Who("u1"), docs.where("Id = 'd1'"), "insert").count() == 1
    for operation in ("insert", "update", "delete"):
        with pytest.raises(AccessDenied):
            check_write(e, "Docs", (own, group), Who("u1"), docs, operation)
