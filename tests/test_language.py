import pytest

from millrace.api.builder import Query
from millrace.api.predicates import all_of, always, any_of, call, col, never
from millrace.lang import QueryError, parse
from millrace.lang import tree as t
from millrace.lang.lint import lint
from millrace.plans.block import build
from millrace.plans.engine import Engine, parameters, placeholders, statement_kind
from millrace.plans.render import Renderer


def sql(text, dialect="postgres"):
    return Renderer(dialect).statement(build(parse(text)))


@pytest.mark.parametrize(
    "text, expected",
    [
        ("users", "SELECT * FROM users"),
        ("users |> select(users.id, users.name as n)", "SELECT users.id, users.name AS n FROM users"),
        ("boats |> filter(fn(b) => b.boats.length_m > 7 and b.boats.port = 'Kiel')", "SELECT * FROM boats WHERE (boats.length_m > 7 AND boats.port = 'Kiel')"),
        ("users |> select_distinct(country)", "SELECT DISTINCT country FROM users"),
        ("orders |> group_by(orders.user_id) |> having(fn(g) => count(*) > 2) |> select(orders.user_id, count(*) as n) |> order_by(n desc)", "SELECT orders.user_id, COUNT(*) AS n FROM orders GROUP BY orders.user_id HAVING COUNT(*) > 2 ORDER BY n DESC"),
        ("users |> join(orders, on = users.id = orders.user_id) |> left_join(p, on = p.id = orders.p)", "SELECT * FROM users INNER JOIN orders ON users.id = orders.user_id LEFT JOIN p ON p.id = orders.p"),
        ("a |> cross_join(b)", "SELECT * FROM a CROSS JOIN b"),
        ("a |> limit(5) |> offset(2) |> select(x)", "SELECT x FROM a LIMIT 5 OFFSET 2"),
        ("a |> select((x + 1) * 2 as y, x - (y - z), x || 'it\\'s')", "SELECT (x + 1) * 2 AS y, x - (y - z), x || 'it''s' FROM a"),
        ("a |> select(case when x > 1 then 'p' else 'q' end as c)", "SELECT CASE WHEN x > 1 THEN 'p' ELSE 'q' END AS c FROM a"),
        ("a |> select(x) |> union(b |> filter(y = 1) |> select(y))", "SELECT x FROM a UNION SELECT y FROM b WHERE y = 1"),
        ("a |> filter(fn(r) => r.x in (1, 2) and r.y is not null and exists(b |> filter(fn(q) => q.b.i = r.a.i)))", "SELECT * FROM a WHERE (x IN (1, 2) AND y IS NOT NULL AND EXISTS (SELECT * FROM b WHERE b.i = a.i))"),
        ("a |> select(row_number() over (partition by k order by v desc))", "SELECT ROW_NUMBER() OVER (PARTITION BY k ORDER BY v DESC) FROM a"),
        ("let j = a |> filter(x = 1)\nj |> select(id, name) |> insert(t)", "INSERT INTO t (id, name) SELECT id, name FROM a WHERE x = 1"),
        ("a |> filter(fn(r) => r.x = @p or not r.y like 'z%')", "SELECT * FROM a WHERE (x = @p OR (NOT y LIKE 'z%'))"),
        ("-- note\na |> select(count(distinct x) as n, current_date() as d, extract('year', t) as y)", "SELECT COUNT(DISTINCT x) AS n, CURRENT_DATE AS d, EXTRACT(year FROM t) AS y FROM a"),
    ],
)
def test_rendering(text, expected):
    assert sql(text) == expected


def test_dialects():
    text = "a |> select(length(x) as n, substring(x, 1, 2) as s) |> order_by(n) |> limit(3) |> offset(1)"
    assert sql(text, "sqlserver") == "SELECT LEN(x) AS n, SUBSTRING(x, 1, 2) AS s FROM a ORDER BY n OFFSET 1 ROWS FETCH NEXT 3 ROWS ONLY"
    assert sql(text, "sqlite") == "SELECT LENGTH(x) AS n, substr(x, 1, 2) AS s FROM a ORDER BY n LIMIT 3 OFFSET 1"
    assert sql("a |> limit(3)", "sqlserver") == "SELECT TOP 3 * FROM a"
    assert sql("a |> offset(3)", "sqlite") == "SELECT * FROM a LIMIT -1 OFFSET 3"
    with pytest.raises(QueryError):
        sql("a", "oracle")


@pytest.mark.parametrize(
    "text, part, line, column",
    [
        ("", "empty", 1, 0),
        ("  \n", "empty", 1, 0),
        ("users select(x)", "Missing '|>'", 1, 6),
        ("users |> select(a$b)", "Unexpected character", 1, 17),
        ("users\n|> filter(fn(r) => r.a = )", "Unexpected ')'", 2, 25),
        ("users |> select(x", "Expected ','", 1, 17),
        ("users |> join(orders)", "needs on", 1, 9),
        ("users |> frobnicate(x)", "Unknown function: frobnicate", 1, 9),
        ("1abc |> select(x)", "can't start with a digit", 1, 0),
        ("users |> select('abc", "Unterminated", 1, 16),
        ("let a = b |> limit(1)\nlet b = a |> limit(2)\na", "Circular", 2, 4),
        ("users |> filter('x')", "condition", 1, 9),
        ("a |> join(a, on = a.x = a.y)", "itself", 1, 5),
        ("users |> filter(fn(r) => case else 1 end)", "when", 1, 30),
    ],
)
def test_errors_have_a_place(text, part, line, column):
    with pytest.raises(QueryError) as e:
        build(parse(text))
    assert part in e.value.message and (e.value.line, e.value.column) == (line, column)


def test_parameters_and_kinds():
    assert placeholders("select @a, :b, $c, ?, '@no', x::int, \"@q\" -- @z\n, @a") == ("select :a, :b, :c, :p1, '@no', x::int, \"@q\" -- @z\n, :a", ["a", "b", "c", "p1"])
    assert parameters("a |> filter(x = @p)") == ["p"]
    kinds = {"SELECT 1": "select", "with x as (select 1) insert into t select * from x": "insert", "-- c\nUPDATE t SET a=1": "update", "delete from t": "delete", "create table t(a int)": "create_table", "drop table t": "drop", "": "other"}
    assert {k: statement_kind(k) for k in kinds} == kinds


def test_lint():
    found = lint("a|> select(frob(x), count(*))")
    assert [(a.level, a.column) for a in found] == [("warning", 0), ("info", 11)]
    assert [a.level for a in lint("a |> selec(x)")] == ["error"]
    assert lint("a |> select(upper(x) as y, '|>x')") == []
    assert lint("a |>")[0].level == "error"


def test_builder_blocks():
    q = Query("t").select("a", "b as c").where("x", "=", 1).or_where("y", ">", 2).and_where("z", "in", [1, 2]).order_by_descending("a").take(3).skip(1)
    assert q.sql("postgres") == "SELECT a, b AS c FROM t WHERE (x = 1 OR (y > 2 AND z IN (1, 2))) ORDER BY a DESC LIMIT 3 OFFSET 1"
    assert Query("t").where(lambda r: (r.a == None) | ~(r.b != "o'k")).sql("sqlite") == "SELECT * FROM t WHERE (a IS NULL OR (NOT b != 'o''k'))"  # noqa: E711
    assert any_of().node == never().node and all_of().node == always().node
    assert all_of(col("a") == 1).node == t.Binary("=", t.Name(("a",)), t.Literal(1))
    assert Query("t").select(call("count", "*").alias("n")).group_by("k").having(call("sum", col("v") * 2) >= 5).sql("postgres") == "SELECT COUNT(*) AS n FROM t GROUP BY k HAVING SUM(v * 2) >= 5"
    with pytest.raises(ValueError):
        Query("t").rows()


@pytest.fixture(scope="module")
def engine(spark):
    users = spark.createDataFrame([("u1", "Ann", 30, "US", "active"), ("u2", "Ben", 25, "UK", "active"), ("u3", "Cho", 45, "US", "inactive"), ("u4", "Dee", 35, None, "active")], "id string, name string, age int, country string, status string")
    orders = spark.createDataFrame([("o1", "u1", 150.0, "completed"), ("o2", "u1", 75.5, "completed"), ("o3", "u2", 200.0, "pending"), ("o4", "u3", 50.0, "completed"), ("o5", "u9", 5.0, "lost")], "id string, user_id string, total double, status string")
    return Engine(spark, {"users": users, "orders": orders})


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_execution(engine):
    assert rows(engine.query("users |> filter(fn(u) => u.age > 28 and u.status = 'active') |> select(users.name)")) == [("Ann",), ("Dee",)]
    assert rows(engine.query("users |> join(orders, on = users.id = orders.user_id) |> group_by(users.name) |> select(users.name, sum(orders.total) as t)")) == [("Ann", 225.5), ("Ben", 200.0), ("Cho", 50.0)]
    assert rows(engine.query("users |> filter(fn(u) => not exists(orders |> filter(fn(o) => o.orders.user_id = u.users.id))) |> select(name)")) == [("Dee",)]
    assert rows(engine.query("users |> select(id) |> union_all(users |> filter(country is null) |> select(id)) |> order_by(id desc) |> limit(2)")) == [("u4",), ("u4",)]
    assert rows(engine.query("users |> filter((@c is null or country = @c)) |> select(id)", {"c": "UK"})) == [("u2",)]
    assert rows(engine.query("users |> select(concat(name, country, '!') as a, name || country as b) |> filter(id = 'u4')")) == [("Dee!", None)]
    assert rows(engine.query("orders |> select(id, total * 2 as twice) |> filter(fn(r) => r.twice > 390)")) == [("o3", 400.0)]
    assert rows(engine.query("range(1, 4)")) == [(1,), (2,), (3,)]
    assert rows(Engine(engine.spark, engine.tables, "truncate").query("users |> select(age / 4 as q) |> filter(id = 'u1')")) == [(7,)]
    assert engine.scalar("SELECT max(age) FROM users WHERE status = @s", {"s": "active"}) == 35 and engine.scalar("SELECT age FROM users WHERE id = 'none'") is None


def test_errors_of_the_engine(engine):
    assert engine.validate("users |> select(name)") == []
    [e] = engine.validate("users\n|> select(nope)")
    assert (e.line, e.column) == (2, 10)
    for text in ("users |> select(frob(name))", "users |> group_by(country) |> select(name)", "nowhere |> select(x)"):
        with pytest.raises(QueryError):
            engine.query(text)
    with pytest.raises(QueryError):
        engine.sql("SELECT @missing")


def test_insert(spark, engine, tmp_path):
    spark.createDataFrame([(1, "a")], "id int, name string").write.parquet(f"{tmp_path}/t.parquet")
    spark.createDataFrame([(7, "x")], "k int, n string").write.parquet(f"{tmp_path}/s.parquet")
    own = Engine(spark, str(tmp_path))
    own.query("s |> select(n as name, k as id) |> insert(t)")
    assert rows(own.query("t")) == [(1, "a"), (7, "x")]
    assert spark.read.parquet(f"{tmp_path}/t.parquet").count() == 1, "a folder is only read unless it is writable"
    from millrace.sources.tables import Tables

    open_ = Engine(spark, Tables(spark, str(tmp_path), writable=True))
    open_.query("s |> insert(t)")
    assert rows(spark.read.parquet(f"{tmp_path}/t.parquet")) == [(1, "a"), (7, "x")]
    with pytest.raises(QueryError):
        open_.query("s |> select(k, n, k) |> insert(t)")
