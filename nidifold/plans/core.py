"""Queries for single operators: bags, lists, nesting, scalars, aggregates and windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import aggregates as agg
from ..functions import scalars as sc
from ..operators import relational as rel
from ..operators.output import positions
from ..operators.simplify import group_by_key
from ..operators.vectors import Map, composed
from ..sources.tables import KEYS, as_list, frame, literal, literal_deep, literal_lists, table
from .common import double, money, query

# Bags


@query("SELECT o_orderkey, o_custkey * 2 + 1 AS twice FROM orders")
def project(spark, sf_dir):
    return table(spark, sf_dir, "orders").project(o_orderkey=F.col("o_orderkey"), twice=F.col("o_custkey") * 2 + 1).frame.select("o_orderkey", "twice")


@query("SELECT c_custkey, c_name FROM customer WHERE c_acctbal > 5000 AND c_mktsegment = 'BUILDING'")
def select(spark, sf_dir):
    v = table(spark, sf_dir, "customer").select((F.col("c_acctbal") > 5000) & (F.col("c_mktsegment") == "BUILDING"))
    return v.frame.select("c_custkey", "c_name")


@query("SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def distinct(spark, sf_dir):
    return frame(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus").distinct()


@query("SELECT o_orderstatus, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(14,2))) AS DOUBLE) AS total FROM orders GROUP BY 1")
def group_aggr(spark, sf_dir):
    v = table(spark, sf_dir, "orders").group_aggregate({"o_orderstatus": F.col("o_orderstatus")}, [agg.count_("n"), agg.Aggregate("total", lambda _: double(F.sum(money("o_totalprice"))))])
    return v.frame.select("o_orderstatus", "n", "total")


@query("SELECT n_nationkey, n_regionkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS rn FROM nation")
def row_number_part(spark, sf_dir):
    return rel.row_number(frame(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey"), "rn", ["n_regionkey"], ["n_nationkey"])


@query("SELECT * FROM (VALUES (1::BIGINT, 'a', 1::BIGINT), (3, 'b', 2), (2, 'c', 3)) t(x, y, pos)")
def literal_list(spark, sf_dir):
    return positions(literal(spark, [(1, "a"), (3, "b"), (2, "c")], "x long, y string"))


@query("SELECT r_regionkey, r_name FROM region")
def scan(spark, sf_dir):
    return table(spark, sf_dir, "region").frame.select("r_regionkey", "r_name")


@query("SELECT r_regionkey, n_nationkey FROM region CROSS JOIN nation")
def cross(spark, sf_dir):
    return table(spark, sf_dir, "region").product(table(spark, sf_dir, "nation")).frame.select("r_regionkey", "n_nationkey")


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderpriority = '1-URGENT'")
def join_equi(spark, sf_dir):
    orders = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderpriority").select(F.col("o_orderpriority") == "1-URGENT")
    return orders.theta_join(table(spark, sf_dir, "customer", "c_custkey", "c_name"), lambda l, r: l("o_custkey") == r("c_custkey")).frame.select("o_orderkey", "c_name")  # noqa: E741


@query("SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b ON a.s_nationkey % 5 = b.s_nationkey % 5 AND a.s_acctbal < b.s_acctbal")
def join_theta_range(spark, sf_dir):
    s = table(spark, sf_dir, "supplier", "s_suppkey", "s_nationkey", "s_acctbal")
    pairs = s.theta_join(s, lambda l, r: (l("s_nationkey") % 5 == r("s_nationkey") % 5) & (l("s_acctbal") < r("s_acctbal")))  # noqa: E741
    return pairs.frame.select(F.col("s_suppkey").alias("a"), F.col("s_suppkey_2").alias("b"))


@query("SELECT a.n_nationkey AS a, b.n_nationkey AS b FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey AND (a.n_regionkey <> b.n_regionkey OR length(a.n_name) <> length(b.n_name))")
def join_tuple_neq(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    on = lambda l, r: (l("n_nationkey") < r("n_nationkey")) & sc.tuple_ne([l("n_regionkey"), F.length(l("n_name"))], [r("n_regionkey"), F.length(r("n_name"))])  # noqa: E731,E741
    return n.theta_join(n, on).frame.select(F.col("n_nationkey").alias("a"), F.col("n_nationkey_2").alias("b"))


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def semi(spark, sf_dir):
    urgent = table(spark, sf_dir, "orders", "o_custkey", "o_orderpriority").select(F.col("o_orderpriority") == "1-URGENT")
    return table(spark, sf_dir, "customer", "c_custkey").semi_join(urgent, lambda l, r: l("c_custkey") == r("o_custkey")).frame.select("c_custkey")  # noqa: E741


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def anti(spark, sf_dir):
    return table(spark, sf_dir, "orders", "o_orderkey").anti_join(table(spark, sf_dir, "lineitem", "l_orderkey"), lambda l, r: l("o_orderkey") == r("l_orderkey")).frame.select("o_orderkey")  # noqa: E741


@query("SELECT c_custkey, coalesce(o_orderkey, -1) AS o_orderkey FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_orderdate >= DATE '2001-07-01') ON o_custkey = c_custkey")
def left_outer_default(spark, sf_dir):
    late = frame(spark, sf_dir, "orders").filter(F.col("o_orderdate") >= F.lit("2001-07-01").cast("date")).select("o_custkey", "o_orderkey")
    return rel.left_outer_default(frame(spark, sf_dir, "customer").select("c_custkey"), late, lambda l, r: l("c_custkey") == r("o_custkey"), {"o_orderkey": -1})  # noqa: E741


@query("""SELECT c_custkey, count(o_orderkey) AS n, CAST(coalesce(sum(CASE WHEN o_orderkey IS NOT NULL THEN CAST(c_acctbal AS DECIMAL(14,2)) END), 0) AS DOUBLE) AS own,
                 coalesce(bool_and(o_orderstatus = 'F'), true) AS all_f, coalesce(bool_or(o_orderstatus = 'P'), false) AS any_p
          FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_orderdate >= DATE '2001-07-01') ON o_custkey = c_custkey GROUP BY c_custkey""")
def group_join(spark, sf_dir):
    late = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate").select(F.col("o_orderdate") >= F.lit("2001-07-01").cast("date"))
    found = lambda l, r: [agg.count_("n"), agg.sum_("own", money(l("c_acctbal"))), agg.all_("all_f", r("o_orderstatus") == "F"), agg.any_("any_p", r("o_orderstatus") == "P")]  # noqa: E731,E741
    v = table(spark, sf_dir, "customer", "c_custkey", "c_acctbal").group_join(late, lambda l, r: l("c_custkey") == r("o_custkey"), found)  # noqa: E741
    return v.frame.select("c_custkey", "n", double(F.col("own")).alias("own"), "all_f", "any_p")


@query("SELECT o_custkey, o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT' EXCEPT ALL SELECT o_custkey, o_orderkey FROM orders WHERE o_orderstatus = 'F'")
def difference(spark, sf_dir):
    orders = frame(spark, sf_dir, "orders")
    return rel.difference(orders.filter("o_orderpriority = '1-URGENT'").select("o_custkey", "o_orderkey"), orders.filter("o_orderstatus = 'F'").select("o_custkey", "o_orderkey"))


@query("SELECT n_name AS name FROM nation UNION ALL SELECT r_name FROM region")
def union_all(spark, sf_dir):
    return rel.union(frame(spark, sf_dir, "nation").select(F.col("n_name").alias("name")), frame(spark, sf_dir, "region").select(F.col("r_name").alias("name")))


# Lists


@query("SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS pos FROM orders")
def number(spark, sf_dir):
    _, inner = table(spark, sf_dir, "orders", "o_custkey", "o_orderkey").group(g=F.col("o_custkey"))
    return positions(inner).select("o_custkey", "o_orderkey", "pos")


_UNIQUE = """SELECT o_custkey, o_orderstatus, row_number() OVER (PARTITION BY o_custkey ORDER BY first) AS pos
             FROM (SELECT o_custkey, o_orderstatus, min(o_orderkey) AS first FROM orders GROUP BY 1, 2)"""


@query(_UNIQUE)
def unique_first(spark, sf_dir):
    _, inner = table(spark, sf_dir, "orders", "o_custkey", "o_orderstatus").group(g=F.col("o_custkey"))
    return positions(inner.unique()).select("o_custkey", "o_orderstatus", "pos")


@query("""SELECT r_regionkey AS owner, name, row_number() OVER (PARTITION BY r_regionkey ORDER BY tag, k) AS pos FROM (
            SELECT n_regionkey AS r_regionkey, 1 AS tag, n_nationkey AS k, n_name AS name FROM nation
            UNION ALL SELECT n_regionkey, 2, s_suppkey, s_name FROM supplier JOIN nation ON s_nationkey = n_nationkey)""")
def append(spark, sf_dir):
    nations = table(spark, sf_dir, "nation")
    _, by_region = nations.project(owner=F.col("n_regionkey"), name=F.col("n_name")).group(g=F.col("owner"))
    suppliers = table(spark, sf_dir, "supplier").theta_join(nations, lambda l, r: l("s_nationkey") == r("n_nationkey"))  # noqa: E741
    _, sup = suppliers.project(owner=F.col("n_regionkey"), name=F.col("s_name")).group(g=F.col("owner"))
    return positions(by_region.append(sup)).select("owner", "name", "pos")


@query("""SELECT a.o_custkey AS owner, a.o_orderkey AS a, b.o_orderkey AS b FROM
            (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS p FROM orders WHERE o_orderstatus = 'F') a
            JOIN (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS p FROM orders WHERE o_orderstatus = 'O') b ON a.o_custkey = b.o_custkey AND a.p = b.p""")
def zip(spark, sf_dir):
    def of(status):
        v = table(spark, sf_dir, "orders", "o_custkey", "o_orderkey", "o_orderstatus").select(F.col("o_orderstatus") == status)
        return v.project(owner=F.col("o_custkey"), x=F.col("o_orderkey")).group(g=F.col("owner"))[1]

    return of("F").zip(of("O")).frame.select("owner", F.col("x").alias("a"), F.col("x_2").alias("b"))


@query("SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS pos FROM orders")
def reverse(spark, sf_dir):
    _, inner = table(spark, sf_dir, "orders", "o_custkey", "o_orderkey").group(g=F.col("o_custkey"))
    return positions(inner.reverse()).select("o_custkey", "o_orderkey", "pos")


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_custkey ELSE -o_custkey END AS x, row_number() OVER (ORDER BY o_orderkey) AS pos FROM orders WHERE o_orderpriority = '1-URGENT'")
def combine(spark, sf_dir):
    v = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority").select(F.col("o_orderpriority") == "1-URGENT")
    then = v.project(o_orderkey=F.col("o_orderkey"), x=F.col("o_custkey"))
    other = v.project(o_orderkey=F.col("o_orderkey"), x=-F.col("o_custkey"))
    return positions(v.project(b=F.col("o_orderstatus") == "F").combine("b", then, other)).select("o_orderkey", "x", "pos")


@query("""SELECT n_nationkey, c_custkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey, c_custkey) AS pos, n_regionkey
          FROM nation JOIN customer ON c_nationkey = n_nationkey""")
def concat(spark, sf_dir):
    _, nations = table(spark, sf_dir, "nation", "n_nationkey", "n_regionkey").group(g=F.col("n_regionkey"))
    customers = nations.unsegment().nest_join(table(spark, sf_dir, "customer", "c_custkey", "c_nationkey"), lambda l, r: l("n_nationkey") == r("c_nationkey"))  # noqa: E741
    return positions(nations.merge(customers)).select("n_regionkey", "n_nationkey", "c_custkey", "pos")


@query("SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderkey) AS pos FROM orders")
def sort_stable(spark, sf_dir):
    _, inner = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderpriority").group(g=F.col("o_custkey"))
    return positions(inner.sort(F.col("o_orderpriority"))).select("o_orderkey", "pos")


@query("SELECT o_custkey, o_orderkey, pos FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS pos FROM orders) WHERE pos <= 2")
def take_n(spark, sf_dir):
    _, inner = table(spark, sf_dir, "orders", "o_custkey", "o_orderkey", "o_orderdate").group(g=F.col("o_custkey"))
    return positions(inner.sort((F.col("o_orderdate"), False)).take(2)).select("o_custkey", "o_orderkey", "pos")


@query("SELECT c_custkey, length(c_name) AS a, c_nationkey + 1 AS b FROM customer")
def align(spark, sf_dir):
    c = table(spark, sf_dir, "customer", "c_custkey", "c_name", "c_nationkey")
    a, b = c.project(c_custkey=F.col("c_custkey"), a=F.length("c_name").cast("long")), c.project(b=F.col("c_nationkey").cast("long") + 1)
    return a.align(b).frame.select("c_custkey", "a", "b")


# Nesting


@query("SELECT r_regionkey, n_nationkey, row_number() OVER (PARTITION BY r_regionkey ORDER BY n_nationkey) AS pos FROM region JOIN nation ON n_regionkey = r_regionkey")
def nest_join(spark, sf_dir):
    pairs = table(spark, sf_dir, "region").nest_join(table(spark, sf_dir, "nation"), lambda l, r: l("r_regionkey") == r("n_regionkey"))  # noqa: E741
    return positions(pairs).select("r_regionkey", "n_nationkey", "pos")


@query("""SELECT dense_rank() OVER (ORDER BY c_mktsegment) AS gpos, c_mktsegment, c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS pos FROM customer""")
def group_nested(spark, sf_dir):
    outer, inner = table(spark, sf_dir, "customer", "c_custkey", "c_mktsegment").group(segment=F.col("c_mktsegment"))
    both = outer.number("gpos").replicate_nest(inner)
    return positions(both).select("gpos", "c_mktsegment", "c_custkey", "pos")


@query("""SELECT c_custkey, CAST(coalesce(sum(CAST(o_totalprice AS DECIMAL(14,2))), 0) AS DOUBLE) AS total, count(o_orderkey) AS n
          FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_orderdate >= DATE '2001-07-01') ON o_custkey = c_custkey GROUP BY 1""")
def fold_default(spark, sf_dir):
    c = table(spark, sf_dir, "customer", "c_custkey")
    late = table(spark, sf_dir, "orders", "o_custkey", "o_totalprice", "o_orderdate").select(F.col("o_orderdate") >= F.lit("2001-07-01").cast("date"))
    inner = c.nest_join(late, lambda l, r: l("c_custkey") == r("o_custkey"))  # noqa: E741
    out = c.aggregate_inner(inner, agg.sum_("total", money("o_totalprice")), agg.count_("n"))
    return out.frame.select("c_custkey", double(F.col("total")).alias("total"), F.col("n").cast("long").alias("n"))


@query("SELECT c_custkey, max(o_orderkey) AS last FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def unbox_sng(spark, sf_dir):
    c = table(spark, sf_dir, "customer", "c_custkey")
    inner = c.nest_join(table(spark, sf_dir, "orders", "o_custkey", "o_orderkey"), lambda l, r: l("c_custkey") == r("o_custkey"))  # noqa: E741
    return c.unbox(inner.fold(agg.max_("last", F.col("o_orderkey")))).frame.select("c_custkey", "last")


@query("SELECT r_regionkey AS owner, x, pos FROM region CROSS JOIN (VALUES (7::BIGINT, 1::BIGINT), (5, 2), (6, 3)) t(x, pos)")
def replicate_vector(spark, sf_dir):
    v = literal(spark, [(7,), (5,), (6,)], "x long").replicate_vector(table(spark, sf_dir, "region"))
    return v.number().frame.select(F.col("_s0").alias("owner"), "x", "pos")


@query("SELECT s_suppkey, s_acctbal > m AS above FROM supplier CROSS JOIN (SELECT avg(s_acctbal) AS m FROM supplier)")
def replicate_scalar(spark, sf_dir):
    s = table(spark, sf_dir, "supplier", "s_suppkey", "s_acctbal")
    out = s.replicate_scalar(s.fold(agg.avg_("m", F.col("s_acctbal"))))
    return out.frame.select("s_suppkey", (F.col("s_acctbal") > F.col("m")).alias("above"))


@query("SELECT c_custkey, o_orderkey FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_mktsegment = 'MACHINERY'")
def filter_inner(spark, sf_dir):
    c = table(spark, sf_dir, "customer", "c_custkey", "c_mktsegment")
    inner = c.nest_join(table(spark, sf_dir, "orders", "o_custkey", "o_orderkey"), lambda l, r: l("c_custkey") == r("o_custkey"))  # noqa: E741
    return c.select(F.col("c_mktsegment") == "MACHINERY").app_filter(inner).frame.select("c_custkey", "o_orderkey")


@query("""SELECT * FROM (VALUES (0::BIGINT, 1::BIGINT, 2::BIGINT, 3::BIGINT), (1, 0, 0, NULL), (2, 1, 1, 5)) t(list, has, n, total)""")
def empty_lists(spark, sf_dir):
    outer, inner = literal_lists(spark, [[(1,), (2,)], [], [(5,)]], "x long")
    named = outer.project(list=F.col("_k0"))
    out = named.aggregate_inner(inner, agg.count_("n"), agg.any_("any", F.col("x") > 0), agg.Aggregate("total", lambda g: F.sum("x")))
    return out.frame.select("list", F.col("any").cast("long").alias("has"), F.col("n").cast("long").alias("n"), "total")


@query("SELECT c_custkey, n_name, o_orderkey FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey WHERE n_regionkey = 1")
def app_rep(spark, sf_dir):
    """Lists of orders by customer, copied to the pairs (nation, customer) that use them."""
    c = table(spark, sf_dir, "customer", "c_custkey", "c_nationkey")
    orders = c.nest_join(table(spark, sf_dir, "orders", "o_custkey", "o_orderkey"), lambda l, r: l("c_custkey") == r("o_custkey"))  # noqa: E741
    pairs = table(spark, sf_dir, "nation").select(F.col("n_regionkey") == 1).theta_join(c, lambda l, r: l("n_nationkey") == r("c_nationkey"))  # noqa: E741
    copies = Map(pairs.frame.select(F.col("_k1").alias("_f0"), F.col("_k0").alias("_t0"), F.col("_k1").alias("_t1")), 1, 2)
    return pairs.replicate_nest(orders.project(o_orderkey=F.col("o_orderkey")).app_rep(copies)).frame.select("c_custkey", "n_name", "o_orderkey")


@query("SELECT c_nationkey, o_orderkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY o_orderkey) AS pos FROM customer JOIN orders ON o_custkey = c_custkey")
def app_key(spark, sf_dir):
    """Lists of orders by customer, renamed to the customers' nations, so that they become one list of each nation."""
    customers = table(spark, sf_dir, "customer", "c_custkey", "c_nationkey").group(n=F.col("c_nationkey"))[1]
    orders = customers.unsegment().nest_join(table(spark, sf_dir, "orders", "o_orderkey", "o_custkey"), lambda l, r: l("c_custkey") == r("o_custkey"))  # noqa: E741
    return positions(orders.app_key(customers.key_map()).app_sort()).select("c_nationkey", "o_orderkey", "pos")


@query("SELECT n_regionkey, c_custkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY c_custkey) AS pos FROM nation JOIN customer ON c_nationkey = n_nationkey")
def compose_maps(spark, sf_dir):
    """Customers in lists by nation, brought to lists by region by two maps in a row."""
    nations = table(spark, sf_dir, "nation", "n_nationkey", "n_regionkey").group(r=F.col("n_regionkey"))[1]
    customers = nations.unsegment().nest_join(table(spark, sf_dir, "customer", "c_custkey", "c_nationkey"), lambda l, r: l("n_nationkey") == r("c_nationkey"))  # noqa: E741
    same = Map(nations.frame.select(F.col("_k0").alias("_f0"), F.col("_k0").alias("_t0")), 1, 1)
    return positions(customers.app_key(composed(same, nations.key_map()))).select("n_regionkey", "c_custkey", "pos")


@query("SELECT o_orderkey AS owner, 1::BIGINT AS n FROM orders")
def segment(spark, sf_dir):
    """Each order in a list of its own."""
    lists = table(spark, sf_dir, "orders", "o_orderkey").segment().fold(agg.count_("n"))
    return lists.frame.select(F.col("_s0").alias("owner"), "n")


@query("SELECT 0 AS list, count(*) AS n, max(r_regionkey) AS last FROM region")
def nest(spark, sf_dir):
    """The list of one list that holds all regions."""
    row, inner = table(spark, sf_dir, "region", "r_regionkey").nest()
    folded = inner.fold(agg.count_("n"), agg.max_("last", F.col("r_regionkey"))).frame.select("_s0", "n", "last")
    return row.join(folded, F.col("_k0") == F.col("_s0")).select(F.col("_k0").alias("list"), "n", "last")


@query("SELECT count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(14,2))) AS DOUBLE) AS total FROM customer JOIN orders ON o_custkey = c_custkey")
def unit_map(spark, sf_dir):
    """Lists of orders by customer, all brought to the one list at the top."""
    customers = table(spark, sf_dir, "customer", "c_custkey")
    orders = customers.nest_join(table(spark, sf_dir, "orders", "o_custkey", "o_totalprice"), lambda l, r: l("c_custkey") == r("o_custkey"))  # noqa: E741
    out = orders.app_key(customers.unit_map()).fold(agg.count_("n"), agg.sum_("total", money("o_totalprice")))
    return out.frame.select("n", double(F.col("total")).alias("total"))


@query("""SELECT * FROM (VALUES (0::BIGINT, 0::BIGINT, 2::BIGINT, 3::BIGINT), (0, 1, 0, NULL), (2, 0, 1, 3), (2, 1, 3, 15), (2, 2, 0, NULL)) t(a, b, n, total)""")
def literal_three_levels(spark, sf_dir):
    """A literal of three levels with empty lists on the two lower ones."""
    outer, middle, inner = literal_deep(spark, [[[(1,), (2,)], []], [], [[(3,)], [(4,), (5,), (6,)], []]], "x long")
    counted = middle.project(b=F.col("_k1")).aggregate_inner(inner, agg.count_("n"), agg.Aggregate("total", lambda g: F.sum("x")))
    return outer.project(a=F.col("_k0")).replicate_nest(counted).frame.select("a", "b", F.col("n").cast("long").alias("n"), "total")


@query("SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS pos FROM orders QUALIFY pos <= 10")
def take_top(spark, sf_dir):
    """The first elements of the list at the top, numbered after all others are gone."""
    return positions(table(spark, sf_dir, "orders", "o_orderkey", "o_totalprice").sort((F.col("o_totalprice"), False)).take(10)).select("o_orderkey", "o_totalprice", "pos")


@query("SELECT c_custkey, count(o_orderkey) AS n, max(o_totalprice) AS most FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P' GROUP BY 1")
def group_join_pairs(spark, sf_dir):
    """A group join on equal columns: the right side is aggregated before the join."""
    some = table(spark, sf_dir, "orders", "o_custkey", "o_totalprice", "o_orderstatus").select(F.col("o_orderstatus") == "P")
    v = table(spark, sf_dir, "customer", "c_custkey").group_join(some, [("c_custkey", "o_custkey")], lambda _, r: [agg.count_("n"), agg.max_("most", r("o_totalprice"))])
    return v.frame.select("c_custkey", F.col("n").cast("long").alias("n"), "most")


# Scalars


@query("SELECT p_partkey, p_brand AS brand, p_size AS size FROM part")
def tuple_parts(spark, sf_dir):
    both = frame(spark, sf_dir, "part").select("p_partkey", sc.tuple_(F.col("p_brand"), F.col("p_size")).alias("t"))
    return both.select("p_partkey", F.col("t._1").alias("brand"), F.col("t._2").alias("size"))


@query("SELECT o_orderkey, o_orderkey + o_custkey AS a, o_orderkey - o_custkey AS s, o_orderkey * 3 AS m, o_orderkey // 7 AS d, o_orderkey % 7 AS r, o_totalprice / 4.0::DOUBLE AS q FROM orders")
def arith(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    return frame(spark, sf_dir, "orders").select("o_orderkey", (k + c).alias("a"), (k - c).alias("s"), (k * 3).alias("m"), sc.int_div(k, F.lit(7).cast("long")).alias("d"), (k % 7).alias("r"), (F.col("o_totalprice") / 4.0).alias("q"))


@query("SELECT n_nationkey, n_regionkey = 1 AS eq, n_regionkey <> 1 AS ne, n_regionkey > 1 AS gt, n_regionkey >= 1 AS ge, n_regionkey < 1 AS lt, n_regionkey <= 1 AS le, n_regionkey = 1 AND n_nationkey > 9 AS a, n_regionkey = 1 OR n_nationkey > 9 AS o, NOT n_regionkey = 1 AS n FROM nation")
def compare_bool(spark, sf_dir):
    r, k = F.col("n_regionkey"), F.col("n_nationkey")
    parts = {"eq": r == 1, "ne": r != 1, "gt": r > 1, "ge": r >= 1, "lt": r < 1, "le": r <= 1, "a": (r == 1) & (k > 9), "o": (r == 1) | (k > 9), "n": ~(r == 1)}
    return frame(spark, sf_dir, "nation").select("n_nationkey", *[c.alias(n) for n, c in parts.items()])


@query("SELECT p_partkey, p_type LIKE 'PRO%' AS promo, regexp_full_match(p_brand, 'Brand#(1|2).*') AS brand FROM part")
def like_regex(spark, sf_dir):
    return frame(spark, sf_dir, "part").select("p_partkey", F.col("p_type").like("PRO%").alias("promo"), sc.similar_to(F.col("p_brand"), "Brand#(1|2)%").alias("brand"))


@query("SELECT c_custkey, substring(c_name, 2, 5) AS s FROM customer")
def substring(spark, sf_dir):
    return frame(spark, sf_dir, "customer").select("c_custkey", sc.substring(F.col("c_name"), 2, 5).alias("s"))


@query("""SELECT o_orderkey, CAST(o_orderdate AS DATE) + 30 AS later, CAST(o_orderdate AS DATE) - 30 AS sooner, datediff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS days,
                 day(o_orderdate)::BIGINT AS d, month(o_orderdate)::BIGINT AS m, year(o_orderdate)::BIGINT AS y FROM orders""")
def date_ops(spark, sf_dir):
    d = F.col("o_orderdate")
    start = F.lit("1995-01-01").cast("date")
    return frame(spark, sf_dir, "orders").select("o_orderkey", sc.add_days(30, d).alias("later"), sc.sub_days(30, d).alias("sooner"), sc.diff_days(start, d).cast("long").alias("days"), sc.day(d).alias("d"), sc.month(d).alias("m"), sc.year(d).alias("y"))


_MATH = ["sin", "cos", "tan", "asin", "acos", "atan", "sqrt", "exp"]


@query("SELECT p_partkey, " + ", ".join(f"round({f}(p_size / 100.0::DOUBLE), 9) AS {f}" for f in _MATH) + ", round(ln(p_size::DOUBLE), 9) AS log FROM part")
def math(spark, sf_dir):
    x = F.col("p_size") / 100.0
    return frame(spark, sf_dir, "part").select("p_partkey", *[F.round(getattr(F, f)(x), 9).alias(f) for f in _MATH], F.round(sc.log(F.col("p_size").cast("double")), 9).alias("log"))


@query("SELECT p_partkey, p_size::DOUBLE AS d, CAST(CAST(p_retailprice AS DECIMAL(38,1)) AS DOUBLE) AS c FROM part")
def cast(spark, sf_dir):
    return frame(spark, sf_dir, "part").select("p_partkey", sc.to_double(F.col("p_size")).alias("d"), double(sc.to_decimal(F.col("p_retailprice"), 1)).alias("c"))


@query("SELECT p_partkey, CASE WHEN p_size > 25 THEN p_name ELSE p_brand END AS a, CASE WHEN p_size > 25 THEN p_size ELSE -p_size END AS b, p_size BETWEEN 10 AND 20 AS c FROM part")
def if_tuple(spark, sf_dir):
    a, b = sc.if_(F.col("p_size") > 25, [F.col("p_name"), F.col("p_size")], [F.col("p_brand"), -F.col("p_size")])
    return frame(spark, sf_dir, "part").select("p_partkey", a.alias("a"), b.alias("b"), F.col("p_size").between(10, 20).alias("c"))


# Aggregates


@query("""SELECT l_returnflag, CAST(sum(CAST(l_quantity AS DECIMAL(14,2))) AS DOUBLE) AS s, min(l_quantity) AS mi, max(l_quantity) AS ma, round(avg(CAST(l_quantity AS DECIMAL(14,2))), 6)::DOUBLE AS av,
                 bool_and(l_quantity > 0) AS al, bool_or(l_quantity > 49) AS an, count(*) AS n, count(DISTINCT l_partkey) AS d FROM lineitem GROUP BY 1""")
def agg_all(spark, sf_dir):
    q = F.col("l_quantity")
    found = [agg.Aggregate("s", lambda _: double(F.sum(money(q)))), agg.min_("mi", q), agg.max_("ma", q), agg.Aggregate("av", lambda _: double(F.round(F.avg(money(q)), 6))), agg.all_("al", q > 0), agg.any_("an", q > 49), agg.count_("n"), agg.count_distinct_("d", F.col("l_partkey"))]
    return table(spark, sf_dir, "lineitem").group_aggregate({"l_returnflag": F.col("l_returnflag")}, found).frame.select("l_returnflag", *[a.name for a in found])


@query("SELECT 0::BIGINT AS s, true AS al, false AS an, 0::BIGINT AS n, NULL::BIGINT AS mi")
def agg_empty_defaults(spark, sf_dir):
    none = frame(spark, sf_dir, "nation").filter("n_nationkey < 0")
    k = F.col("n_nationkey").cast("long")
    return rel.grand_aggregate(none, [agg.sum_("s", k), agg.all_("al", k > 0), agg.any_("an", k > 0), agg.count_("n"), agg.min_("mi", k)])


@query("SELECT l_suppkey, count(DISTINCT l_partkey) AS parts FROM lineitem GROUP BY 1")
def count_distinct(spark, sf_dir):
    v = table(spark, sf_dir, "lineitem", "l_suppkey", "l_partkey").group_aggregate({"l_suppkey": F.col("l_suppkey")}, [agg.count_distinct_("parts", F.col("l_partkey"))])
    return v.frame.select("l_suppkey", "parts")


@query("SELECT c_custkey, c_name, c_mktsegment, count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2, 3")
def group_by_declared_key(spark, sf_dir):
    both = frame(spark, sf_dir, "customer").join(frame(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"))
    return group_by_key(both, ["c_custkey", "c_name", "c_mktsegment"], [F.count(F.lit(1)).alias("n")], KEYS["customer"])


# Windows

_W = "OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN"


def _orders_of_customers(spark, sf_dir):
    return table(spark, sf_dir, "orders", "o_custkey", "o_orderkey", "o_totalprice", "o_orderstatus").group(g=F.col("o_custkey"))[1]


@query(f"SELECT o_orderkey, CAST(sum(CAST(o_totalprice AS DECIMAL(14,2))) {_W} UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) AS s, count(*) {_W} UNBOUNDED PRECEDING AND CURRENT ROW) AS n, max(o_totalprice) {_W} UNBOUNDED PRECEDING AND CURRENT ROW) AS m FROM orders")
def win_running(spark, sf_dir):
    v = _orders_of_customers(spark, sf_dir)
    v = v.window_function("s", "sum", money("o_totalprice")).window_function("n", "count").window_function("m", "max", F.col("o_totalprice"))
    return v.frame.select("o_orderkey", double(F.col("s")).alias("s"), "n", "m")


@query(f"SELECT o_orderkey, CAST(sum(CAST(o_totalprice AS DECIMAL(14,2))) {_W} 2 PRECEDING AND CURRENT ROW) AS DOUBLE) AS s, min(o_totalprice) {_W} 2 PRECEDING AND CURRENT ROW) AS mi, round(avg(CAST(o_totalprice AS DECIMAL(14,2))) {_W} 2 PRECEDING AND CURRENT ROW), 4)::DOUBLE AS av FROM orders")
def win_sliding(spark, sf_dir):
    v = _orders_of_customers(spark, sf_dir)
    v = v.window_function("s", "sum", money("o_totalprice"), 2).window_function("mi", "min", F.col("o_totalprice"), 2).window_function("av", "avg", money("o_totalprice"), 2)
    return v.frame.select("o_orderkey", double(F.col("s")).alias("s"), "mi", double(F.round("av", 4)).alias("av"))


@query(f"SELECT o_orderkey, bool_and(o_orderstatus = 'F') {_W} 1 PRECEDING AND CURRENT ROW) AS al, bool_or(o_orderstatus = 'P') {_W} UNBOUNDED PRECEDING AND CURRENT ROW) AS an FROM orders")
def win_bool(spark, sf_dir):
    v = _orders_of_customers(spark, sf_dir)
    v = v.window_function("al", "all", F.col("o_orderstatus") == "F", 1).window_function("an", "any", F.col("o_orderstatus") == "P")
    return v.frame.select("o_orderkey", "al", "an")


@query(f"SELECT o_orderkey, first_value(o_orderkey) {_W} UNBOUNDED PRECEDING AND CURRENT ROW) AS f, first_value(o_orderkey) {_W} 3 PRECEDING AND CURRENT ROW) AS f3, last_value(o_orderkey) {_W} UNBOUNDED PRECEDING AND CURRENT ROW) AS l FROM orders")
def win_first_last(spark, sf_dir):
    k = F.col("o_orderkey")
    v = _orders_of_customers(spark, sf_dir).window_function("f", "first", k).window_function("f3", "first", k, 3).window_function("l", "last", k)
    return v.frame.select("o_orderkey", "f", "f3", "l")


@query("SELECT p_partkey, rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS r, dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS d FROM part")
def rank(spark, sf_dir):
    parts = frame(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size")
    return rel.rank(rel.rank(parts, "r", ["p_size"], ["p_brand"]), "d", ["p_size"], ["p_brand"], dense=True).select("p_partkey", "r", "d")


@query("SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos, sum(1) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS nth FROM events")
def event_lists(spark, sf_dir):
    events = frame(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts")
    v = as_list(events, ["event_id"], ["ts", "event_id"])
    by_user = v.group(u=F.col("user_id"))[1].number()
    return by_user.group(t=F.col("event_type"))[1].window_function("nth", "count").frame.select("event_id", "user_id", "pos", "nth")
