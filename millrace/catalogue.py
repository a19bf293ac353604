"""The registered queries of the language and the fluent API, each with SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from millrace.api.predicates import all_of, always, any_of, call, col, never
from millrace.plans.engine import Engine

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def _text(name: str, text: str, sql: str, params: dict | None = None, **options: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: Engine(spark, sf_dir, **options).query(text, params)
    ORACLE_SQL[name] = sql


def _sql(name: str, text: str, sql: str | None = None, params: dict | None = None) -> None:
    QUERIES[name] = lambda spark, sf_dir: Engine(spark, sf_dir).sql(text, params)
    ORACLE_SQL[name] = sql or text


def _fluent(name: str, make: Callable[[Engine], DataFrame], sql: str) -> None:
    QUERIES[name] = lambda spark, sf_dir: make(Engine(spark, sf_dir))
    ORACLE_SQL[name] = sql


FLAGSHIP = """
customer
|> join(orders, on = customer.c_custkey = orders.o_custkey)
|> join(lineitem, on = orders.o_orderkey = lineitem.l_orderkey)
|> filter(fn(row) => row.orders.o_orderdate >= @since)
|> group_by(customer.c_mktsegment)
|> having(fn(g) => count(*) > 10)
|> select(
    customer.c_mktsegment as segment,
    count(*) as lines,
    count(distinct orders.o_orderkey) as n_orders,
    sum(round(lineitem.l_extendedprice * (1 - lineitem.l_discount) * 10000, 0)) as revenue
)
|> order_by(revenue desc)
|> limit(5)
"""
_text(
    "flagship_segment_revenue",
    FLAGSHIP,
    """SELECT c_mktsegment AS segment, count(*) AS lines, count(DISTINCT o_orderkey) AS n_orders, sum(round(l_extendedprice * (1 - l_discount) * 10000, 0)) AS revenue
    FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey
    WHERE o_orderdate >= TIMESTAMP '1995-01-01' GROUP BY c_mktsegment HAVING count(*) > 10 ORDER BY revenue DESC LIMIT 5""",
    {"since": "1995-01-01"},
)

# Scans and projections.
_text("select_columns", "orders |> select(o_orderkey, o_custkey, o_totalprice)", "SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
_text("select_star", "region |> select(*)", "SELECT * FROM region")
_text("bare_table", "nation", "SELECT * FROM nation")
_text("nested_base", "(customer |> filter(fn(c) => c.c_nationkey < 5)) |> select(c_custkey, c_name)", "SELECT c_custkey, c_name FROM customer WHERE c_nationkey < 5")
_text("select_alias", "supplier |> select(supplier.s_suppkey as id, supplier.s_name as name)", "SELECT s_suppkey AS id, s_name AS name FROM supplier")
_text("select_distinct", "customer |> select_distinct(c_mktsegment, c_nationkey)", "SELECT DISTINCT c_mktsegment, c_nationkey FROM customer")
_text("distinct_step", "orders |> select(o_orderstatus, o_orderpriority) |> distinct()", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
_text("map_step", "part |> map(p_partkey as k, p_size * 2 as twice)", "SELECT p_partkey AS k, p_size * 2 AS twice FROM part")
_text("range_source", "range(3, 9) |> select(id as n, id * id as square)", "SELECT range AS n, range * range AS square FROM range(3, 9)")
_text("arithmetic", "lineitem |> select(l_orderkey, l_linenumber, l_quantity + l_linenumber as a, l_quantity - 1 as b, l_quantity * 3 as c, l_linenumber % 3 as d)", "SELECT l_orderkey, l_linenumber, l_quantity + l_linenumber AS a, l_quantity - 1 AS b, l_quantity * 3 AS c, l_linenumber % 3 AS d FROM lineitem")
_text("brackets", "part |> select(p_partkey, (p_size + 2) * (p_size - 1) as a, -(p_size) as b, p_size - (3 - p_size) as c)", "SELECT p_partkey, (p_size + 2) * (p_size - 1) AS a, -(p_size) AS b, p_size - (3 - p_size) AS c FROM part")
_text("integer_division", "part |> select(p_partkey, p_size / 4 as whole, p_retailprice / 2 as half)", "SELECT p_partkey, p_size // 4 AS whole, p_retailprice / 2 AS half FROM part", int_division="truncate")
_text("case_expr", "part |> select(p_partkey, case when p_size > 30 then 'large' when p_size > 10 and p_size < 20 then 'middling' else 'other' end as size_class)", "SELECT p_partkey, CASE WHEN p_size > 30 THEN 'large' WHEN p_size > 10 AND p_size < 20 THEN 'middling' ELSE 'other' END AS size_class FROM part")
_text("string_concat", "nation |> select(n_nationkey, n_name || '-' || n_regionkey as label)", "SELECT n_nationkey, n_name || '-' || n_regionkey AS label FROM nation")
_text("scalar_subquery", "customer |> filter(fn(c) => c.c_acctbal > (customer |> select(avg(round(c_acctbal * 100, 0)) / 100))) |> select(c_custkey)", "SELECT c_custkey FROM customer WHERE c_acctbal > (SELECT avg(round(c_acctbal * 100, 0)) / 100 FROM customer)")

# Filters.
_text("filter_simple", "orders |> filter(fn(row) => row.orders.o_totalprice > 200000) |> select(o_orderkey)", "SELECT o_orderkey FROM orders WHERE o_totalprice > 200000")
_text("filter_bare", "orders |> filter(o_orderstatus = 'F') |> filter() |> select(o_orderkey)", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'")
_text("filter_and_or", "part |> filter(fn(r) => r.p_size < 5 or r.p_size > 45 and r.p_retailprice > 950) |> select(p_partkey)", "SELECT p_partkey FROM part WHERE p_size < 5 OR p_size > 45 AND p_retailprice > 950")
_text("filter_multi", "part |> filter(fn(r) => r.p_size < 9 or r.p_size > 41) |> filter(fn(r) => r.p_partkey < 900 or r.p_partkey > 1500) |> select(p_partkey)", "SELECT p_partkey FROM part WHERE (p_size < 9 OR p_size > 41) AND (p_partkey < 900 OR p_partkey > 1500)")
_text("filter_after_select", "part |> select(p_partkey, p_size * 2 as twice) |> filter(fn(r) => r.p_size > 40 and r.twice < 92)", "SELECT p_partkey, p_size * 2 AS twice FROM part WHERE p_size > 40 AND p_size * 2 < 92")
_text("filter_like", "part |> filter(fn(r) => r.p_type like '%DI%' or r.p_name like 'b%') |> select(p_partkey, p_type)", "SELECT p_partkey, p_type FROM part WHERE p_type LIKE '%DI%' OR p_name LIKE 'b%'")
_text("filter_in_list", "orders |> filter(fn(r) => r.o_orderstatus in ('F', 'P')) |> select(o_orderkey)", "SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('F', 'P')")
_text("filter_in_single", "orders |> filter(fn(r) => r.o_orderstatus in ('O')) |> select(o_orderkey)", "SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('O')")
_text("filter_null_check", "customer |> left_join(orders, on = customer.c_custkey = orders.o_custkey and orders.o_totalprice > 300000) |> filter(fn(r) => r.orders.o_orderkey is null and r.c_name is not null) |> select(c_custkey)", "SELECT c_custkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_totalprice > 300000 WHERE o_orderkey IS NULL AND c_name IS NOT NULL")
_text("filter_between", "part |> filter(fn(r) => r.p_size between 10 and 12 and r.p_partkey not between 100 and 1000) |> select(p_partkey)", "SELECT p_partkey FROM part WHERE p_size BETWEEN 10 AND 12 AND p_partkey NOT BETWEEN 100 AND 1000")
_text("filter_not", "part |> filter(fn(r) => not (r.p_size > 10 or r.p_size = 3) and r.p_type not like 'S%' and r.p_size not in (1, 2)) |> select(p_partkey)", "SELECT p_partkey FROM part WHERE NOT (p_size > 10 OR p_size = 3) AND p_type NOT LIKE 'S%' AND p_size NOT IN (1, 2)")
_text("filter_case_predicate", "part |> filter(fn(r) => case when r.p_size > 40 then r.p_retailprice > 930 when r.p_size > 20 then r.p_retailprice > 950 else r.p_retailprice > 970 end) |> select(p_partkey)", "SELECT p_partkey FROM part WHERE CASE WHEN p_size > 40 THEN p_retailprice > 930 WHEN p_size > 20 THEN p_retailprice > 950 ELSE p_retailprice > 970 END")
_OPTIONAL = "customer |> filter(fn(r) => (@segment is null or r.c_mktsegment = @segment) and r.c_nationkey >= @from) |> select(c_custkey)"
_text("filter_param_optional", _OPTIONAL, "SELECT c_custkey FROM customer WHERE c_nationkey >= 20", {"segment": None, "from": 20})
_text("filter_param_given", _OPTIONAL, "SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey >= 20", {"segment": "BUILDING", "from": 20})


def _udf_predicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION is_member(k BIGINT, n INT) RETURNS BOOLEAN RETURN k % 7 = n % 7")
    return Engine(spark, sf_dir).query("customer |> filter(fn(c) => is_member(c.c_custkey, c.c_nationkey)) |> select(c_custkey)")


QUERIES["filter_udf_predicate"] = _udf_predicate
ORACLE_SQL["filter_udf_predicate"] = "SELECT c_custkey FROM customer WHERE c_custkey % 7 = c_nationkey % 7"

# Joins.
_text("join_inner", "customer |> join(nation, on = customer.c_nationkey = nation.n_nationkey) |> select(c_custkey, n_name)", "SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
_text("join_left", "customer |> left_join(orders, on = customer.c_custkey = orders.o_custkey and orders.o_orderstatus = 'P') |> select(c_custkey, o_orderkey)", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'P'")
_text("join_right", "orders |> right_join(customer, on = orders.o_custkey = customer.c_custkey) |> select(c_custkey, o_orderkey)", "SELECT c_custkey, o_orderkey FROM orders RIGHT JOIN customer ON o_custkey = c_custkey")
_text("join_full", "supplier |> full_join(customer, on = supplier.s_suppkey = customer.c_custkey and supplier.s_nationkey = customer.c_nationkey) |> select(s_suppkey, c_custkey)", "SELECT s_suppkey, c_custkey FROM supplier FULL JOIN customer ON s_suppkey = c_custkey AND s_nationkey = c_nationkey")
_text("join_cross", "region |> cross_join(nation) |> select(r_name, n_name)", "SELECT r_name, n_name FROM region CROSS JOIN nation")
_text("join_chain", "region |> join(nation, on = region.r_regionkey = nation.n_regionkey) |> join(supplier, on = nation.n_nationkey = supplier.s_nationkey) |> select(r_name, n_name, s_name)", "SELECT r_name, n_name, s_name FROM region JOIN nation ON r_regionkey = n_regionkey JOIN supplier ON n_nationkey = s_nationkey")
_text("join_theta", "region |> join(nation, on = nation.n_nationkey > region.r_regionkey * 5 and nation.n_nationkey <= region.r_regionkey * 5 + 3) |> select(r_regionkey, n_nationkey)", "SELECT r_regionkey, n_nationkey FROM region JOIN nation ON n_nationkey > r_regionkey * 5 AND n_nationkey <= r_regionkey * 5 + 3")
_text("join_self", "nation |> join(nation as other, on = nation.n_regionkey = other.n_regionkey and nation.n_nationkey < other.n_nationkey) |> select(nation.n_name as a, other.n_name as b)", "SELECT x.n_name AS a, y.n_name AS b FROM nation x JOIN nation y ON x.n_regionkey = y.n_regionkey AND x.n_nationkey < y.n_nationkey")
_text(
    "join_nested_pipeline",
    "customer |> join((orders |> filter(fn(o) => o.orders.o_orderstatus = 'F') |> group_by(orders.o_custkey) |> select(orders.o_custkey, count(*) as order_count)), on = customer.c_custkey = orders.o_custkey) |> select(customer.c_name, orders.order_count)",
    "SELECT c_name, order_count FROM customer JOIN (SELECT o_custkey, count(*) AS order_count FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey) o ON c_custkey = o.o_custkey",
)
_text(
    "join_let",
    "let big = orders |> filter(fn(o) => o.o_totalprice > 250000) |> select(o_custkey, o_orderkey)\ncustomer |> join(big, on = customer.c_custkey = big.o_custkey) |> select(c_custkey, big.o_orderkey)",
    "SELECT c_custkey, o_orderkey FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_totalprice > 250000",
)

# Predicates over other rows.
_text("exists_correlated", "customer |> filter(fn(c) => exists(orders |> filter(fn(o) => o.orders.o_custkey = c.customer.c_custkey and o.orders.o_totalprice > 200000))) |> select(c_custkey)", "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)")
_text("exists_inequality", "nation |> filter(fn(n) => exists(region |> filter(fn(r) => r.region.r_regionkey * 4 > n.nation.n_nationkey and r.region.r_regionkey <> n.nation.n_regionkey))) |> select(n_name)", "SELECT n_name FROM nation WHERE EXISTS (SELECT 1 FROM region WHERE r_regionkey * 4 > n_nationkey AND r_regionkey <> n_regionkey)")
_text("not_exists", "customer |> filter(fn(c) => not exists(orders |> filter(fn(o) => o.o_custkey = c.c_custkey and o.o_totalprice > 300000))) |> select(c_custkey)", "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
_text("in_subquery", "customer |> filter(fn(c) => c.customer.c_custkey in (orders |> filter(fn(o) => o.orders.o_orderstatus = 'P') |> select(orders.o_custkey))) |> select(c_custkey)", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
_text("not_in_subquery", "part |> filter(fn(p) => p.p_partkey not in (lineitem |> filter(fn(l) => l.l_quantity > 45) |> select(l_partkey))) |> select(p_partkey)", "SELECT p_partkey FROM part WHERE p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)")

# Aggregates.
_text("group_count", "orders |> group_by(o_orderstatus) |> select(o_orderstatus, count(*) as n)", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus")
_text("group_multi_agg", "lineitem |> group_by(l_returnflag) |> group_by(l_linestatus) |> select(l_returnflag, l_linestatus, count(*) as n, sum(l_quantity) as total, avg(l_quantity) as mean, min(l_extendedprice) as low, max(l_extendedprice) as high)", "SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS total, avg(l_quantity) AS mean, min(l_extendedprice) AS low, max(l_extendedprice) AS high FROM lineitem GROUP BY l_returnflag, l_linestatus")
_text("global_agg", "lineitem |> select(count(*) as n, sum(l_quantity) as total, max(l_shipdate) as last_ship)", "SELECT count(*) AS n, sum(l_quantity) AS total, max(l_shipdate) AS last_ship FROM lineitem")
_text("count_distinct", "orders |> group_by(o_orderpriority) |> select(o_orderpriority, count(distinct o_custkey) as customers, count(o_orderkey) as n)", "SELECT o_orderpriority, count(DISTINCT o_custkey) AS customers, count(o_orderkey) AS n FROM orders GROUP BY o_orderpriority")
_text("sum_distinct", "lineitem |> group_by(l_returnflag) |> select(l_returnflag, sum(distinct l_quantity) as s)", "SELECT l_returnflag, sum(DISTINCT l_quantity) AS s FROM lineitem GROUP BY l_returnflag")
_text("having_count", "orders |> group_by(o_custkey) |> having(fn(g) => count(*) > 12 and max(o_totalprice) > 1000) |> select(o_custkey, count(*) as n)", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12 AND max(o_totalprice) > 1000")
_text("having_bare", "orders |> group_by(o_custkey) |> having(count(*) > 15) |> select(o_custkey)", "SELECT o_custkey FROM orders GROUP BY o_custkey HAVING count(*) > 15")
_text("agg_expressions", "lineitem |> group_by(l_suppkey) |> select(l_suppkey, sum(l_quantity * l_linenumber) as weighted, round(avg(l_quantity) * 8, 0) as rounded, abs(sum(l_quantity) - 50 * count(*)) as off)", "SELECT l_suppkey, sum(l_quantity * l_linenumber) AS weighted, round(avg(l_quantity) * 8, 0) AS rounded, abs(sum(l_quantity) - 50 * count(*)) AS off FROM lineitem GROUP BY l_suppkey")
_sql("rollup_sql", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
_sql("cube_sql", "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS q FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
_sql("grouping_sets_sql", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")
_sql("filter_clause_sql", "SELECT o_orderstatus, count(*) FILTER (WHERE o_totalprice > 150000) AS high FROM orders GROUP BY o_orderstatus")

# Windows.
_W = "over (partition by lineitem.l_orderkey order by lineitem.l_linenumber, lineitem.l_partkey, lineitem.l_extendedprice)"
_D = "OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_extendedprice)"
_text("row_number", "orders |> select(o_orderkey, row_number() over (partition by orders.o_custkey order by orders.o_totalprice desc, orders.o_orderkey) as place)", "SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders")
_text("rank", "part |> select(p_partkey, rank() over (partition by p_brand order by p_size) as place)", "SELECT p_partkey, rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS place FROM part")
_text("dense_rank", "part |> select(p_partkey, dense_rank() over (partition by p_brand order by p_size desc) as place)", "SELECT p_partkey, dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size DESC) AS place FROM part")
_text("lag_lead", f"lineitem |> select(l_orderkey, l_linenumber, lag(l_quantity, 1) {_W} as before, lead(l_quantity, 1, 0.0) {_W} as after)", f"SELECT l_orderkey, l_linenumber, lag(l_quantity, 1) {_D} AS before, lead(l_quantity, 1, 0.0) {_D} AS after FROM lineitem")
_text("ntile", "customer |> select(c_custkey, ntile(4) over (partition by c_nationkey order by c_custkey) as quarter)", "SELECT c_custkey, ntile(4) OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS quarter FROM customer")
_text("window_sum", f"lineitem |> select(l_orderkey, l_linenumber, sum(l_quantity) {_W} as running, count(*) over (partition by l_orderkey) as lines)", f"SELECT l_orderkey, l_linenumber, sum(l_quantity) {_D} AS running, count(*) OVER (PARTITION BY l_orderkey) AS lines FROM lineitem")
_sql("window_frame_sql", f"SELECT l_orderkey, l_linenumber, sum(l_quantity) {_D[:-1]} ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS near FROM lineitem")
_sql("window_named_sql", "SELECT o_orderkey, rank() OVER w AS r, count(*) OVER w AS c FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate)")
_sql("window_analytic_sql", "SELECT p_partkey, first_value(p_size) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS f, nth_value(p_size, 2) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS n2, percent_rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS pr FROM part")
_text(
    "top_n_per_group",
    "let ranked = orders |> select(o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as place)\nranked |> filter(fn(r) => r.place <= 2)",
    "SELECT o_custkey, o_orderkey, place FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders) WHERE place <= 2",
)

# Order and pages.
_text("order_multi", "orders |> select(o_orderkey, o_orderstatus, o_totalprice) |> order_by(o_orderstatus, o_totalprice desc) |> order_by(o_orderkey asc)", "SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders ORDER BY o_orderstatus, o_totalprice DESC, o_orderkey")
_text("top_k", "lineitem |> select(l_orderkey, l_linenumber, l_extendedprice) |> order_by(l_extendedprice desc, l_orderkey, l_linenumber) |> limit(20)", "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 20")
_text("offset_limit", "orders |> limit(7) |> offset(5) |> order_by(o_orderkey) |> select(o_orderkey)", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 7 OFFSET 5")
_text("limit_default", "orders |> order_by(o_orderkey) |> select(o_orderkey) |> limit()", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10")

# Sets.
_text("union_distinct", "customer |> select(c_nationkey as k) |> union(supplier |> filter(fn(s) => s.s_nationkey < 12) |> select(s_nationkey as k))", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier WHERE s_nationkey < 12")
_text("union_all", "customer |> select(c_nationkey as k) |> union_all(supplier |> select(s_nationkey as k))", "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
_text("union_mixed", "region |> select(r_regionkey as k) |> union_all(region |> select(r_regionkey as k)) |> union(nation |> select(n_regionkey as k)) |> union_all(region |> filter(r_regionkey = 1) |> select(r_regionkey as k))", "(SELECT r_regionkey AS k FROM region UNION ALL SELECT r_regionkey FROM region UNION SELECT n_regionkey FROM nation) UNION ALL SELECT r_regionkey FROM region WHERE r_regionkey = 1")
_text("union_let", "let a = customer |> filter(fn(c) => c.c_nationkey = 3) |> select(c_custkey as k)\nlet b = supplier |> select(s_suppkey as k)\na |> union(b) |> order_by(k) |> limit(30)", "SELECT c_custkey AS k FROM customer WHERE c_nationkey = 3 UNION SELECT s_suppkey FROM supplier ORDER BY k LIMIT 30")
_text("intersect_step", "customer |> select(c_nationkey as k) |> intersect(supplier |> select(s_nationkey as k))", "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
_sql("intersect_sql", "SELECT l_suppkey AS k FROM lineitem WHERE l_quantity > 40 INTERSECT SELECT s_suppkey FROM supplier")
_sql("except_sql", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 300000")
_text("except_step", "customer |> select(c_nationkey as k) |> except(supplier |> filter(s_acctbal > 5000) |> select(s_nationkey as k))", "SELECT c_nationkey AS k FROM customer EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000")
_text("cte_let", "with busy as (orders |> group_by(orders.o_custkey) |> having(fn(g) => count(*) > 12) |> select(orders.o_custkey))\ncustomer |> join(busy, on = customer.c_custkey = busy.o_custkey) |> select(c_custkey, c_name)", "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders GROUP BY o_custkey HAVING count(*) > 12)")
_sql("recursive_cte_sql", "WITH RECURSIVE n(i) AS (SELECT 1 UNION ALL SELECT i + 1 FROM n WHERE i < 20) SELECT i, i * i AS square FROM n")
_sql("natural_using_sql", "SELECT n_name, x.c FROM nation JOIN (SELECT c_nationkey AS n_nationkey, count(*) AS c FROM customer GROUP BY c_nationkey) x USING (n_nationkey)")
_sql("natural_join_sql", "SELECT n_nationkey, n_name, total FROM nation NATURAL JOIN (SELECT s_nationkey AS n_nationkey, count(*) AS total FROM supplier GROUP BY s_nationkey) x")
_sql("within_group_sql", "SELECT p_brand, percentile_cont(0.5) WITHIN GROUP (ORDER BY p_size) AS middle FROM part GROUP BY p_brand")
_sql("values_sql", "SELECT v.k, v.name, n.n_name FROM (VALUES (1, 'one'), (2, 'two')) AS v(k, name) LEFT JOIN nation n ON n.n_nationkey = v.k")
_sql("lateral_sql", "SELECT n.n_name, s.top FROM nation n, LATERAL (SELECT max(s_suppkey) AS top FROM supplier WHERE s_nationkey = n.n_nationkey) s")
_sql("params_sql", "SELECT c_custkey FROM customer WHERE c_nationkey = @nation AND c_acctbal > $least AND c_mktsegment <> ':x'", "SELECT c_custkey FROM customer WHERE c_nationkey = 7 AND c_acctbal > 100", {"nation": 7, "least": 100})

# Scalar functions.
_text(
    "string_funcs",
    "part |> select(p_partkey, upper(p_name) as u, lower(p_brand) as l, length(p_type) as n, substring(p_type, 2, 4) as s, trim('  x ' || p_brand || ' ') as t, concat(p_brand, null, '/', p_type) as c, replace(p_type, 'A', 'aa') as r)",
    "SELECT p_partkey, upper(p_name) AS u, lower(p_brand) AS l, length(p_type) AS n, substring(p_type, 2, 4) AS s, trim('  x ' || p_brand || ' ') AS t, concat(p_brand, NULL, '/', p_type) AS c, replace(p_type, 'A', 'aa') AS r FROM part",
)
_text("math_funcs", "supplier |> select(s_suppkey, floor(s_acctbal) as f, ceil(s_acctbal) as c, abs(s_acctbal) as a, sqrt(abs(s_acctbal)) as q, power(s_nationkey, 2) as p, mod(s_suppkey, 7) as m)", "SELECT s_suppkey, CAST(floor(s_acctbal) AS BIGINT) AS f, CAST(ceil(s_acctbal) AS BIGINT) AS c, abs(s_acctbal) AS a, sqrt(abs(s_acctbal)) AS q, CAST(power(s_nationkey, 2) AS DOUBLE) AS p, s_suppkey % 7 AS m FROM supplier")
_text(
    "date_funcs",
    "orders |> select(o_orderkey, extract(year, o_orderdate) as y, extract('month', o_orderdate) as m, day(o_orderdate) as d, date_trunc('month', o_orderdate) as t, year(o_orderdate) as y2)",
    "SELECT o_orderkey, CAST(extract(year FROM o_orderdate) AS INTEGER) AS y, CAST(extract(month FROM o_orderdate) AS INTEGER) AS m, CAST(day(o_orderdate) AS INTEGER) AS d, date_trunc('month', o_orderdate) AS t, CAST(year(o_orderdate) AS INTEGER) AS y2 FROM orders",
)
_text("date_add", "orders |> select(o_orderkey, date_add('day', 40, o_orderdate) as later, date_add('month', 2, o_orderdate) as months)", "SELECT o_orderkey, o_orderdate + INTERVAL 40 DAY AS later, o_orderdate + INTERVAL 2 MONTH AS months FROM orders")
_text("nested_calls", "part |> filter(fn(p) => length(upper(trim(p.p_name))) > 5 and abs(p.p_size - 25) < 10) |> select(p_partkey, round(sqrt(power(p_size, 2)), 0) as size)", "SELECT p_partkey, round(sqrt(power(p_size, 2)), 0) AS size FROM part WHERE length(upper(trim(p_name))) > 5 AND abs(p_size - 25) < 10")
_text("first_last", "orders |> select(o_custkey, first(o_orderkey) over (partition by o_custkey order by o_orderdate, o_orderkey) as opening, last(o_orderkey) over (partition by o_custkey order by o_orderdate, o_orderkey) as latest)", "SELECT o_custkey, first(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS opening, last(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS latest FROM orders")
_text("null_funcs", "nation |> select(n_nationkey, coalesce(nullif(n_regionkey, 2), 99) as a, isnull(nullif(n_regionkey, 1)) as b, isnotnull(n_name) as c)", "SELECT n_nationkey, coalesce(nullif(n_regionkey, 2), 99) AS a, nullif(n_regionkey, 1) IS NULL AS b, n_name IS NOT NULL AS c FROM nation")

# The fluent API.
_fluent("builder_where_order_take", lambda e: e.from_("orders").select("o_orderkey", "o_totalprice").where("o_totalprice", ">", 100000).and_where("o_orderstatus", "=", "F").order_by_descending("o_totalprice").then_by("o_orderkey").skip(3).take(15).rows(), "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 100000 AND o_orderstatus = 'F' ORDER BY o_totalprice DESC, o_orderkey LIMIT 15 OFFSET 3")
_fluent("builder_join", lambda e: e.from_("customer").join("nation", "customer.c_nationkey", "nation.n_nationkey").left_join("region", "nation.n_regionkey", "r.r_regionkey", "r").select("c_custkey", "n_name as nation_name", "r.r_name").where(lambda r: r.c_acctbal > 500).rows(), "SELECT c_custkey, n_name AS nation_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN region ON n_regionkey = r_regionkey WHERE c_acctbal > 500")
_fluent("builder_and_or_precedence", lambda e: e.from_("part").select("p_partkey").where("p_size", "=", 1).or_where("p_size", ">", 40).and_where("p_retailprice", "<", 990).rows(), "SELECT p_partkey FROM part WHERE p_size = 1 OR (p_size > 40 AND p_retailprice < 990)")
_fluent("builder_group", lambda e: e.from_("orders").group_by("o_orderstatus").select("o_orderstatus", call("count", "*").alias("n")).having(call("count", "*") > 1).rows(), "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus HAVING count(*) > 1")
_fluent("builder_distinct_union", lambda e: e.from_("customer").select("c_nationkey").distinct().union(e.from_("supplier").select("s_nationkey")).rows(), "SELECT c_nationkey FROM customer UNION SELECT s_nationkey FROM supplier")
_fluent("predicate_builder_or", lambda e: e.from_("customer").select("c_custkey").where(any_of(*[col("c_mktsegment") == s for s in ("BUILDING", "MACHINERY")]) & (col("c_nationkey") < 10)).rows(), "SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') AND c_nationkey < 10")
_fluent("predicate_builder_not", lambda e: e.from_("customer").select("c_custkey").where(~all_of(col("c_nationkey") > 3, col("c_acctbal") > 0) & always() | never()).rows(), "SELECT c_custkey FROM customer WHERE NOT (c_nationkey > 3 AND c_acctbal > 0)")
_fluent("predicate_strings", lambda e: e.from_("part").select("p_partkey").where(col("p_type").contains("DI") | col("p_name").startswith("b") | col("p_name").isin()).rows(), "SELECT p_partkey FROM part WHERE contains(p_type, 'DI') OR starts_with(p_name, 'b')")
_fluent("predicate_null", lambda e: e.from_("orders").select("o_orderkey").where(col("o_custkey") != None).where(col("o_totalprice").between(1000, 90000)).rows(), "SELECT o_orderkey FROM orders WHERE o_custkey IS NOT NULL AND o_totalprice BETWEEN 1000 AND 90000")  # noqa: E711
