"""Queries with nested results, flattened with positions. Each nested result is also available as arrays or as a bundle."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import aggregates as agg
from ..functions import scalars as sc
from ..operators.relational import group_join_equi
from ..operators.output import Nested, positions, to_bundle, to_nested
from ..sources.tables import as_list, frame, table
from .common import SQL_REVENUE, double, money, query, revenue


def _orders_by_customer(spark, sf_dir, customers):
    orders = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    return customers.nest_join(orders, lambda l, r: l("c_custkey") == r("o_custkey"))  # noqa: E741


@query("""SELECT c_custkey, pos, o_orderkey, o_totalprice FROM (
            SELECT c_custkey, o_orderkey, o_totalprice, row_number() OVER (PARTITION BY c_custkey ORDER BY o_totalprice DESC, o_orderkey) AS pos
            FROM customer JOIN orders ON o_custkey = c_custkey WHERE c_nationkey = 2) WHERE pos <= 3""")
def top_orders_per_customer(spark, sf_dir):
    customers = table(spark, sf_dir, "customer", "c_custkey", "c_nationkey").select(F.col("c_nationkey") == 2)
    inner = _orders_by_customer(spark, sf_dir, customers).sort((F.col("o_totalprice"), False)).take(3)
    return positions(inner).select("c_custkey", "pos", "o_orderkey", "o_totalprice")


@query("""SELECT r_regionkey, pos, c_custkey, spent FROM (
            SELECT r_regionkey, c_custkey, CAST(spent AS DOUBLE) AS spent, row_number() OVER (PARTITION BY r_regionkey ORDER BY spent DESC, n_nationkey, c_custkey) AS pos
            FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey
                 JOIN (SELECT o_custkey, sum(CAST(o_totalprice AS DECIMAL(14,2))) AS spent FROM orders GROUP BY 1) ON o_custkey = c_custkey) WHERE pos <= 5""")
def regions_top_customers(spark, sf_dir):
    spent = table(spark, sf_dir, "orders", "o_custkey", "o_totalprice").group_aggregate({"o_custkey": F.col("o_custkey")}, [agg.sum_("spent", money("o_totalprice"))])
    customers = table(spark, sf_dir, "customer", "c_custkey", "c_nationkey").theta_join(spent, lambda l, r: l("c_custkey") == r("o_custkey"))  # noqa: E741
    nations = table(spark, sf_dir, "nation", "n_nationkey", "n_regionkey").theta_join(customers, lambda l, r: l("n_nationkey") == r("c_nationkey"))  # noqa: E741
    inner = table(spark, sf_dir, "region", "r_regionkey").nest_join(nations, lambda l, r: l("r_regionkey") == r("n_regionkey"))  # noqa: E741
    top = inner.sort((F.col("spent"), False)).take(5)
    return positions(top).select("r_regionkey", "pos", "c_custkey", double(F.col("spent")).alias("spent"))


@query("""SELECT n_name, c_custkey, dense_rank() OVER (PARTITION BY n_nationkey ORDER BY c_custkey) AS cpos, o_orderkey, row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderkey) AS pos
          FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey WHERE n_regionkey = 1""")
def customers_from_orders(spark, sf_dir):
    """Nations, their customers, and their orders: three levels as one value, taken apart again."""
    nations = table(spark, sf_dir, "nation", "n_nationkey", "n_name", "n_regionkey").select(F.col("n_regionkey") == 1)
    customers = nations.nest_join(table(spark, sf_dir, "customer", "c_custkey", "c_nationkey"), lambda l, r: l("n_nationkey") == r("c_nationkey"))  # noqa: E741
    customers = customers.project(c_custkey=F.col("c_custkey"))
    flat = customers.unsegment()
    orders = flat.nest_join(table(spark, sf_dir, "orders", "o_orderkey", "o_custkey"), lambda l, r: l("c_custkey") == r("o_custkey")).project(o_orderkey=F.col("o_orderkey"))  # noqa: E741
    tree = Nested(nations.project(n_name=F.col("n_name")), {"customers": Nested(customers, {"orders": Nested(orders)})})
    customer = to_nested(tree).select("n_name", F.posexplode("customers").alias("cpos", "c")).filter(F.size("c.orders") > 0)
    # Customers without orders have positions too; the rank counts those with orders.
    flat = customer.select("n_name", "cpos", F.col("c.c_custkey").alias("c_custkey"), F.posexplode("c.orders").alias("pos", "o"))
    rank = F.dense_rank().over(Window.partitionBy("n_name").orderBy("cpos")).cast("long")
    return flat.select("n_name", "c_custkey", rank.alias("cpos"), F.col("o.o_orderkey").alias("o_orderkey"), (F.col("pos") + 1).cast("long").alias("pos"))


@query(f"""SELECT c_custkey, CAST(coalesce(sum(r), 0) AS DOUBLE) AS revenue, count(r) AS items FROM customer
           LEFT JOIN (SELECT o_custkey, {SQL_REVENUE} AS r FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderdate >= DATE '2000-01-01') ON o_custkey = c_custkey GROUP BY 1""")
def customer_revenues(spark, sf_dir):
    orders = frame(spark, sf_dir, "orders").filter(F.col("o_orderdate") >= F.lit("2000-01-01").cast("date")).select("o_orderkey", "o_custkey")
    items = frame(spark, sf_dir, "lineitem").select("l_orderkey", revenue().alias("r"))
    sold = orders.join(items, F.col("o_orderkey") == F.col("l_orderkey"))
    customers = frame(spark, sf_dir, "customer").select("c_custkey")
    out = group_join_equi(customers, sold, [("c_custkey", "o_custkey")], [agg.sum_("revenue", F.col("r")), agg.count_("items")])
    return out.select("c_custkey", double(F.col("revenue")).alias("revenue"), F.col("items").cast("long").alias("items"))


@query("""SELECT o_orderkey, datediff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS delay,
                 row_number() OVER (PARTITION BY o_orderkey ORDER BY l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice) AS pos
          FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderpriority = '1-URGENT'""")
def shipping_delay(spark, sf_dir):
    urgent = table(spark, sf_dir, "orders", "o_orderkey", "o_orderdate", "o_orderpriority").select(F.col("o_orderpriority") == "1-URGENT")
    inner = urgent.nest_join(table(spark, sf_dir, "lineitem", "l_orderkey", "l_shipdate"), lambda l, r: l("o_orderkey") == r("l_orderkey"))  # noqa: E741
    delays = inner.project(o_orderkey=F.col("o_orderkey"), delay=sc.diff_days(F.col("o_orderdate"), F.col("l_shipdate")).cast("long"))
    return positions(delays).select("o_orderkey", "delay", "pos")


@query(f"""SELECT n_name, CAST(coalesce(sum(r), 0) AS DOUBLE) AS expected FROM nation JOIN customer ON c_nationkey = n_nationkey
           LEFT JOIN (SELECT o_custkey, {SQL_REVENUE} AS r FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderstatus = 'O') ON o_custkey = c_custkey GROUP BY n_name""")
def expected_revenue(spark, sf_dir):
    """Of each nation the revenue of its customers' open orders."""
    open_ = table(spark, sf_dir, "orders", "o_orderkey", "o_custkey", "o_orderstatus").select(F.col("o_orderstatus") == "O")
    items = table(spark, sf_dir, "lineitem", "l_orderkey", "l_extendedprice", "l_discount").project(l_orderkey=F.col("l_orderkey"), r=revenue())
    by_customer = open_.theta_join(items, lambda l, r: l("o_orderkey") == r("l_orderkey")).group_aggregate({"o_custkey": F.col("o_custkey")}, [agg.sum_("r", F.col("r"))])  # noqa: E741
    customers = table(spark, sf_dir, "customer", "c_custkey", "c_nationkey").theta_join(by_customer, lambda l, r: l("c_custkey") == r("o_custkey"))  # noqa: E741
    nations = table(spark, sf_dir, "nation", "n_nationkey", "n_name")
    inner = nations.nest_join(customers, lambda l, r: l("n_nationkey") == r("c_nationkey"))  # noqa: E741
    out = nations.aggregate_inner(inner, agg.sum_("expected", F.col("r")))
    return out.frame.select("n_name", double(F.col("expected")).alias("expected"))


@query("""SELECT o_orderkey, l_linenumber, l_quantity, row_number() OVER (PARTITION BY o_orderkey ORDER BY l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice) AS pos
          FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_shipdate > DATE '2001-06-01' AND o_orderstatus = 'O'""")
def unshipped_items(spark, sf_dir):
    open_ = table(spark, sf_dir, "orders", "o_orderkey", "o_orderstatus").select(F.col("o_orderstatus") == "O")
    items = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_quantity", "l_shipdate").select(F.col("l_shipdate") > F.lit("2001-06-01").cast("date"))
    inner = open_.nest_join(items, lambda l, r: l("o_orderkey") == r("l_orderkey"))  # noqa: E741
    return positions(inner).select("o_orderkey", "l_linenumber", "l_quantity", "pos")


_CHEAPER = "WITH offer AS (SELECT l_partkey AS p, l_suppkey AS s, min(CAST(l_extendedprice AS DECIMAL(14,2)) / l_quantity::DOUBLE) AS price FROM lineitem GROUP BY 1, 2)"


def _offers(spark, sf_dir):
    items = table(spark, sf_dir, "lineitem", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    return items.group_aggregate({"p": F.col("l_partkey"), "s": F.col("l_suppkey")}, [agg.min_("price", double(money("l_extendedprice")) / F.col("l_quantity"))])


@query(f"""{_CHEAPER} SELECT a.p AS part, a.s AS supplier, b.s AS cheaper, row_number() OVER (PARTITION BY a.p, a.s ORDER BY b.price, b.s) AS pos
           FROM offer a JOIN offer b ON a.p = b.p AND b.price < a.price""")
def cheaper_suppliers(spark, sf_dir):
    offers = _offers(spark, sf_dir)
    inner = offers.nest_join(offers, lambda l, r: (l("p") == r("p")) & (r("price") < l("price"))).sort(F.col("price_2"))  # noqa: E741
    return positions(inner).select(F.col("p").alias("part"), F.col("s").alias("supplier"), F.col("s_2").alias("cheaper"), "pos")


@query(f"""{_CHEAPER} SELECT o.p AS part, o.s AS supplier FROM offer o JOIN (SELECT p, avg(price) AS m FROM offer GROUP BY 1) a ON a.p = o.p AND o.price < a.m * 0.9""")
def cheaper_suppliers_avg(spark, sf_dir):
    offers = _offers(spark, sf_dir)
    mean = offers.group_aggregate({"q": F.col("p")}, [agg.avg_("m", F.col("price"))])
    out = offers.theta_join(mean, lambda l, r: (l("p") == r("q")) & (l("price") < r("m") * 0.9))  # noqa: E741
    return out.frame.select(F.col("p").alias("part"), F.col("s").alias("supplier"))


@query(f"""{_CHEAPER}, e AS (SELECT p, s, price FROM offer JOIN supplier ON s_suppkey = s JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey WHERE r_name = 'EUROPE')
           SELECT p AS part, s AS supplier, row_number() OVER (PARTITION BY p ORDER BY s) AS pos FROM e JOIN (SELECT p AS q, avg(price) AS m FROM e GROUP BY 1) ON p = q WHERE price < m""")
def cheaper_suppliers_avg2(spark, sf_dir):
    """Of each part the list of a region's suppliers that are cheaper than the mean of that region's offers."""
    region = frame(spark, sf_dir, "region").filter("r_name = 'EUROPE'")
    nations = frame(spark, sf_dir, "nation").join(region, F.col("n_regionkey") == F.col("r_regionkey"), "left_semi")
    suppliers = as_list(frame(spark, sf_dir, "supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey"), "left_semi"), ["s_suppkey"])
    offers = _offers(spark, sf_dir).semi_join(suppliers, lambda l, r: l("s") == r("s_suppkey"))  # noqa: E741
    parts = as_list(offers.frame.select(F.col("p").alias("q")).distinct(), ["q"])
    mean = parts.group_join(offers, [("q", "p")], lambda _, r: [agg.avg_("m", r("price"))])
    inner = mean.nest_join(offers, lambda l, r: (l("q") == r("p")) & (r("price") < l("m")))  # noqa: E741
    return positions(inner).select(F.col("p").alias("part"), F.col("s").alias("supplier"), "pos")


@query("SELECT n_name, c_custkey, row_number() OVER (PARTITION BY n_nationkey ORDER BY c_custkey) AS pos FROM nation JOIN customer ON c_nationkey = n_nationkey WHERE n_regionkey = 2")
def bundle(spark, sf_dir):
    """A nested result as one DataFrame for each level, put together again by what the lower one says of its lists."""
    nations = table(spark, sf_dir, "nation", "n_nationkey", "n_name", "n_regionkey").select(F.col("n_regionkey") == 2)
    customers = nations.nest_join(table(spark, sf_dir, "customer", "c_custkey", "c_nationkey"), lambda l, r: l("n_nationkey") == r("c_nationkey"))  # noqa: E741
    upper, lower = to_bundle(Nested(nations.project(n_name=F.col("n_name")), {"customers": Nested(customers.number().project(c_custkey=F.col("c_custkey"), pos=F.col("pos")))}))
    return upper.join(lower, F.col("_k0") == F.col("_s0")).select("n_name", "c_custkey", "pos")


@query("SELECT conv_id, role, n, chars, row_number() OVER (PARTITION BY conv_id ORDER BY role) AS pos FROM (SELECT conv_id, role, count(*) AS n, sum(length(text))::BIGINT AS chars FROM conversations GROUP BY 1, 2)")
def conversation_roles(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").group(conv_id=F.col("conv_id"))[1]
    roles = turns.group_aggregate({"role": F.col("role")}, [agg.count_("n"), agg.sum_("chars", F.length("text").cast("long"))])
    return positions(roles.project(conv_id=F.col("_s0"), role=F.col("role"), n=F.col("n"), chars=F.col("chars"))).select("conv_id", "role", "n", "chars", "pos")
