"""Decision-support queries over the star schema, adapted to the tables' columns."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import scalars as sc
from ..operators.relational import group_join_equi
from ..functions import aggregates as agg
from ..sources.tables import frame
from .common import SQL_REVENUE, double, money, query, revenue


def date(text):
    return F.lit(text).cast("date")


def year_of(c):
    return sc.year(F.col(c))


@query(f"""SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_quantity AS DECIMAL(14,2))) AS DOUBLE) AS sum_qty, CAST(sum(CAST(l_extendedprice AS DECIMAL(14,2))) AS DOUBLE) AS sum_base,
              CAST(sum({SQL_REVENUE}) AS DOUBLE) AS sum_disc, round(avg(CAST(l_quantity AS DECIMAL(14,2))), 6)::DOUBLE AS avg_qty, round(avg(CAST(l_discount AS DECIMAL(14,2))), 6)::DOUBLE AS avg_disc, count(*) AS n
           FROM lineitem WHERE l_shipdate <= DATE '2001-06-01' GROUP BY 1, 2""")
def q1(spark, sf_dir):
    rows = frame(spark, sf_dir, "lineitem").filter(F.col("l_shipdate") <= date("2001-06-01"))
    mean = lambda c: double(F.round(F.avg(money(c)), 6))
    return rows.groupBy("l_returnflag", "l_linestatus").agg(
        double(F.sum(money("l_quantity"))).alias("sum_qty"), double(F.sum(money("l_extendedprice"))).alias("sum_base"), double(F.sum(revenue())).alias("sum_disc"),
        mean("l_quantity").alias("avg_qty"), mean("l_discount").alias("avg_disc"), F.count(F.lit(1)).alias("n"),
    )


@query(f"""SELECT l_orderkey, CAST(sum({SQL_REVENUE}) AS DOUBLE) AS revenue, CAST(o_orderdate AS DATE) AS day FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
           WHERE c_mktsegment = 'BUILDING' AND o_orderdate < DATE '1998-03-15' AND l_shipdate > DATE '1998-03-15' GROUP BY 1, 3 ORDER BY sum({SQL_REVENUE}) DESC, day, l_orderkey LIMIT 10""")
def q3(spark, sf_dir):
    customers = frame(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'").select("c_custkey")
    orders = frame(spark, sf_dir, "orders").filter(F.col("o_orderdate") < date("1998-03-15")).select("o_orderkey", "o_custkey", "o_orderdate")
    items = frame(spark, sf_dir, "lineitem").filter(F.col("l_shipdate") > date("1998-03-15")).select("l_orderkey", revenue().alias("r"))
    rows = orders.join(customers, F.col("c_custkey") == F.col("o_custkey"), "left_semi").join(items, F.col("l_orderkey") == F.col("o_orderkey"))
    # The order's date depends on its key, so it is no grouping column.
    sums = rows.groupBy("l_orderkey").agg(F.sum("r").alias("r"), F.first("o_orderdate").cast("date").alias("day"))
    return sums.orderBy(F.desc("r"), "day", "l_orderkey").limit(10).select("l_orderkey", double(F.col("r")).alias("revenue"), "day")


@query("""SELECT o_orderpriority, count(*) AS n FROM orders WHERE o_orderdate >= DATE '1997-07-01' AND o_orderdate < DATE '1997-10-01'
          AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') GROUP BY 1""")
def q4(spark, sf_dir):
    orders = frame(spark, sf_dir, "orders").filter((F.col("o_orderdate") >= date("1997-07-01")) & (F.col("o_orderdate") < date("1997-10-01")))
    back = frame(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select("l_orderkey")
    return orders.join(back, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))


@query(f"""SELECT n_name, CAST(sum({SQL_REVENUE}) AS DOUBLE) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
           JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
           WHERE r_name = 'ASIA' AND o_orderdate >= DATE '1996-01-01' AND o_orderdate < DATE '1998-01-01' GROUP BY 1""")
def q5(spark, sf_dir):
    nations = frame(spark, sf_dir, "nation").join(frame(spark, sf_dir, "region").filter("r_name = 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey"), "left_semi")
    suppliers = frame(spark, sf_dir, "supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "s_nationkey", "n_name")
    orders = frame(spark, sf_dir, "orders").filter((F.col("o_orderdate") >= date("1996-01-01")) & (F.col("o_orderdate") < date("1998-01-01")))
    bought = orders.join(frame(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_nationkey")
    items = frame(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", revenue().alias("r")).join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
    rows = items.join(bought, (F.col("l_orderkey") == F.col("o_orderkey")) & (F.col("c_nationkey") == F.col("s_nationkey")))
    return rows.groupBy("n_name").agg(double(F.sum("r")).alias("revenue"))


@query("""SELECT CAST(sum(CAST(l_extendedprice AS DECIMAL(14,2)) * CAST(l_discount AS DECIMAL(14,2))) AS DOUBLE) AS revenue FROM lineitem
          WHERE l_shipdate >= DATE '1996-01-01' AND l_shipdate < DATE '1997-01-01' AND CAST(l_discount AS DECIMAL(14,2)) BETWEEN 0.05 AND 0.07 AND l_quantity < 24""")
def q6(spark, sf_dir):
    rows = frame(spark, sf_dir, "lineitem").filter((F.col("l_shipdate") >= date("1996-01-01")) & (F.col("l_shipdate") < date("1997-01-01")) & money("l_discount").between(0.05, 0.07) & (F.col("l_quantity") < 24))
    return rows.agg(double(F.sum(money("l_extendedprice") * money("l_discount"))).alias("revenue"))


@query(f"""SELECT a.n_name AS supp, b.n_name AS cust, year(l_shipdate)::BIGINT AS y, CAST(sum({SQL_REVENUE}) AS DOUBLE) AS revenue
           FROM supplier JOIN lineitem ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation a ON s_nationkey = a.n_nationkey JOIN nation b ON c_nationkey = b.n_nationkey
           WHERE a.n_regionkey = 0 AND b.n_regionkey = 1 AND l_shipdate >= DATE '1996-01-01' AND l_shipdate < DATE '1998-01-01' GROUP BY 1, 2, 3""")
def q7(spark, sf_dir):
    nation = frame(spark, sf_dir, "nation")
    suppliers = frame(spark, sf_dir, "supplier").join(nation.filter("n_regionkey = 0").select("n_nationkey", F.col("n_name").alias("supp")), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "supp")
    customers = frame(spark, sf_dir, "customer").join(nation.filter("n_regionkey = 1").select("n_nationkey", F.col("n_name").alias("cust")), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "cust")
    orders = frame(spark, sf_dir, "orders").join(customers, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "cust")
    items = frame(spark, sf_dir, "lineitem").filter((F.col("l_shipdate") >= date("1996-01-01")) & (F.col("l_shipdate") < date("1998-01-01")))
    rows = items.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey")).join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.groupBy("supp", "cust", year_of("l_shipdate").alias("y")).agg(double(F.sum(revenue())).alias("revenue"))


@query(f"""SELECT y, round(CAST(sum(CASE WHEN n_name = 'NATION_2' THEN r ELSE 0 END) AS DOUBLE) / CAST(sum(r) AS DOUBLE), 9) AS share FROM (
           SELECT year(o_orderdate)::BIGINT AS y, {SQL_REVENUE} AS r, n_name FROM lineitem JOIN part ON p_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON s_nationkey = n_nationkey
           WHERE p_type = 'ECONOMY' AND o_orderdate >= DATE '1996-01-01' AND o_orderdate < DATE '1998-01-01') GROUP BY y""")
def q8(spark, sf_dir):
    parts = frame(spark, sf_dir, "part").filter("p_type = 'ECONOMY'").select("p_partkey")
    suppliers = frame(spark, sf_dir, "supplier").join(frame(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name")
    orders = frame(spark, sf_dir, "orders").filter((F.col("o_orderdate") >= date("1996-01-01")) & (F.col("o_orderdate") < date("1998-01-01"))).select("o_orderkey", year_of("o_orderdate").alias("y"))
    items = frame(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", revenue().alias("r"))
    rows = items.join(parts, F.col("l_partkey") == F.col("p_partkey"), "left_semi").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
    share = double(F.sum(F.when(F.col("n_name") == "NATION_2", F.col("r")).otherwise(0))) / double(F.sum("r"))
    return rows.groupBy("y").agg(F.round(share, 9).alias("share"))


@query(f"""SELECT n_name, year(o_orderdate)::BIGINT AS y, CAST(sum({SQL_REVENUE}) AS DOUBLE) AS amount FROM part JOIN lineitem ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey JOIN nation ON s_nationkey = n_nationkey
           WHERE p_name LIKE '%red%' GROUP BY 1, 2""")
def q9(spark, sf_dir):
    parts = frame(spark, sf_dir, "part").filter(F.col("p_name").like("%red%")).select("p_partkey")
    suppliers = frame(spark, sf_dir, "supplier").join(frame(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name")
    items = frame(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", revenue().alias("r")).join(parts, F.col("l_partkey") == F.col("p_partkey"), "left_semi")
    rows = items.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey")).join(frame(spark, sf_dir, "orders").select("o_orderkey", year_of("o_orderdate").alias("y")), F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.groupBy("n_name", "y").agg(double(F.sum("r")).alias("amount"))


@query(f"""SELECT c_custkey, c_name, CAST(sum({SQL_REVENUE}) AS DOUBLE) AS revenue, c_acctbal, n_name FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN nation ON c_nationkey = n_nationkey
           WHERE o_orderdate >= DATE '1997-10-01' AND o_orderdate < DATE '1998-01-01' AND l_returnflag = 'R' GROUP BY 1, 2, 4, 5 ORDER BY sum({SQL_REVENUE}) DESC, c_custkey LIMIT 20""")
def q10(spark, sf_dir):
    orders = frame(spark, sf_dir, "orders").filter((F.col("o_orderdate") >= date("1997-10-01")) & (F.col("o_orderdate") < date("1998-01-01"))).select("o_orderkey", "o_custkey")
    items = frame(spark, sf_dir, "lineitem").filter("l_returnflag = 'R'").select("l_orderkey", revenue().alias("r"))
    # Customers' columns depend on their key: sums by key first, then twenty customers are looked up.
    sums = orders.join(items, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_custkey").agg(F.sum("r").alias("r"))
    top = sums.orderBy(F.desc("r"), "o_custkey").limit(20)
    rows = frame(spark, sf_dir, "customer").join(F.broadcast(top), F.col("c_custkey") == F.col("o_custkey")).join(frame(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.select("c_custkey", "c_name", double(F.col("r")).alias("revenue"), "c_acctbal", "n_name")


@query("""SELECT n, count(*) AS customers FROM (SELECT c_custkey, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderpriority <> '1-URGENT' GROUP BY 1) GROUP BY 1""")
def q13(spark, sf_dir):
    orders = frame(spark, sf_dir, "orders").filter("o_orderpriority <> '1-URGENT'").select("o_custkey")
    counted = group_join_equi(frame(spark, sf_dir, "customer").select("c_custkey"), orders, [("c_custkey", "o_custkey")], [agg.count_("n")])
    return counted.groupBy(F.col("n").cast("long").alias("n")).agg(F.count(F.lit(1)).alias("customers"))


@query(f"""SELECT round(100.0 * CAST(sum(CASE WHEN p_type LIKE 'PROMO%' THEN {SQL_REVENUE} ELSE 0 END) AS DOUBLE) / CAST(sum({SQL_REVENUE}) AS DOUBLE), 9) AS promo FROM lineitem JOIN part ON l_partkey = p_partkey
           WHERE l_shipdate >= DATE '1997-09-01' AND l_shipdate < DATE '1997-10-01'""")
def q14(spark, sf_dir):
    items = frame(spark, sf_dir, "lineitem").filter((F.col("l_shipdate") >= date("1997-09-01")) & (F.col("l_shipdate") < date("1997-10-01"))).select("l_partkey", revenue().alias("r"))
    rows = items.join(frame(spark, sf_dir, "part").select("p_partkey", F.col("p_type").like("PROMO%").alias("promo")), F.col("l_partkey") == F.col("p_partkey"))
    return rows.agg(F.round(F.lit(100.0) * double(F.sum(F.when(F.col("promo"), F.col("r")).otherwise(0))) / double(F.sum("r")), 9).alias("promo"))


_Q15 = f"SELECT l_suppkey, sum({SQL_REVENUE}) AS r FROM lineitem WHERE l_shipdate >= DATE '1998-01-01' AND l_shipdate < DATE '1998-04-01' GROUP BY 1"


@query(f"WITH v AS ({_Q15}) SELECT s_suppkey, s_name, CAST(r AS DOUBLE) AS revenue FROM supplier JOIN v ON l_suppkey = s_suppkey WHERE r = (SELECT max(r) FROM v)")
def q15(spark, sf_dir):
    items = frame(spark, sf_dir, "lineitem").filter((F.col("l_shipdate") >= date("1998-01-01")) & (F.col("l_shipdate") < date("1998-04-01")))
    sums = items.groupBy("l_suppkey").agg(F.sum(revenue()).alias("r"))
    top = sums.agg(F.max("r").alias("top"))
    best = sums.join(F.broadcast(top), F.col("r") == F.col("top"), "left_semi")
    return frame(spark, sf_dir, "supplier").join(best, F.col("l_suppkey") == F.col("s_suppkey")).select("s_suppkey", "s_name", double(F.col("r")).alias("revenue"))


@query("""SELECT round(CAST(sum(CAST(l_extendedprice AS DECIMAL(14,2))) AS DOUBLE) / 7.0, 6) AS yearly FROM lineitem JOIN part ON p_partkey = l_partkey JOIN (SELECT l_partkey AS k, avg(l_quantity) AS m FROM lineitem GROUP BY 1) ON k = l_partkey
          WHERE p_brand IN ('Brand#12', 'Brand#23', 'Brand#1', 'Brand#2') AND l_quantity < 0.5 * m""")
def q17(spark, sf_dir):
    """One pass over the line items of the brands: the mean of each part is a window over what is shuffled anyway."""
    parts = frame(spark, sf_dir, "part").filter(F.col("p_brand").isin("Brand#12", "Brand#23", "Brand#1", "Brand#2")).select("p_partkey")
    items = frame(spark, sf_dir, "lineitem").select("l_partkey", "l_quantity", "l_extendedprice").join(parts, F.col("l_partkey") == F.col("p_partkey"), "left_semi")
    few = items.withColumn("m", F.avg("l_quantity").over(Window.partitionBy("l_partkey"))).filter(F.col("l_quantity") < 0.5 * F.col("m"))
    return few.agg(F.round(double(F.sum(money("l_extendedprice"))) / 7.0, 6).alias("yearly"))


@query("""SELECT c_name, c_custkey, o_orderkey, CAST(o_orderdate AS DATE) AS day, o_totalprice, q AS quantity FROM (SELECT l_orderkey, CAST(sum(CAST(l_quantity AS DECIMAL(14,2))) AS DOUBLE) AS q FROM lineitem GROUP BY 1) JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey WHERE q > 250""")
def q18(spark, sf_dir):
    sums = frame(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(double(F.sum(money("l_quantity"))).alias("quantity")).filter("quantity > 250")
    rows = frame(spark, sf_dir, "orders").join(sums, F.col("o_orderkey") == F.col("l_orderkey")).join(frame(spark, sf_dir, "customer").select("c_custkey", "c_name"), F.col("o_custkey") == F.col("c_custkey"))
    return rows.select("c_name", "c_custkey", "o_orderkey", F.col("o_orderdate").cast("date").alias("day"), "o_totalprice", "quantity")


_Q19 = "((p_brand = 'Brand#1' AND l_quantity BETWEEN 1 AND 11 AND p_size BETWEEN 1 AND 15) OR (p_brand = 'Brand#2' AND l_quantity BETWEEN 10 AND 20 AND p_size BETWEEN 1 AND 30) OR (p_brand = 'Brand#3' AND l_quantity BETWEEN 20 AND 30 AND p_size BETWEEN 1 AND 50))"


@query(f"SELECT CAST(coalesce(sum({SQL_REVENUE}), 0) AS DOUBLE) AS revenue FROM lineitem JOIN part ON p_partkey = l_partkey WHERE {_Q19}")
def q19(spark, sf_dir):
    rows = frame(spark, sf_dir, "lineitem").join(frame(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size"), F.col("l_partkey") == F.col("p_partkey")).filter(F.expr(_Q19))
    return rows.agg(double(F.coalesce(F.sum(revenue()), F.lit(0))).alias("revenue"))


# There are no supplier offers, ship modes or receipt dates, so offers are taken from what was sold, and lateness from order dates.

_OFFER = "SELECT l_partkey AS p, l_suppkey AS s, min(CAST(l_extendedprice AS DECIMAL(14,2)) / l_quantity::DOUBLE) AS price FROM lineitem GROUP BY 1, 2"


@query(f"""WITH o AS ({_OFFER}), e AS (SELECT s_acctbal, s_name, n_name, p, price FROM o JOIN supplier ON s = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
             JOIN part ON p = p_partkey WHERE r_name = 'EUROPE' AND p_type = 'PROMO' AND p_size BETWEEN 10 AND 30)
           SELECT s_acctbal, s_name, n_name, p AS part, price FROM e WHERE price = (SELECT min(price) FROM e f WHERE f.p = e.p) ORDER BY s_acctbal DESC, n_name, s_name, p LIMIT 100""")
def q2(spark, sf_dir):
    """The cheapest suppliers of a region for parts of a kind; line items are filtered by both before they are grouped."""
    nations = frame(spark, sf_dir, "nation").join(frame(spark, sf_dir, "region").filter("r_name = 'EUROPE'"), F.col("n_regionkey") == F.col("r_regionkey"), "left_semi")
    suppliers = frame(spark, sf_dir, "supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "s_name", "s_acctbal", "n_name")
    parts = frame(spark, sf_dir, "part").filter((F.col("p_type") == "PROMO") & F.col("p_size").between(10, 30)).select("p_partkey")
    items = frame(spark, sf_dir, "lineitem").join(parts, F.col("l_partkey") == F.col("p_partkey"), "left_semi").join(suppliers.select("s_suppkey"), F.col("l_suppkey") == F.col("s_suppkey"), "left_semi")
    offers = items.groupBy(F.col("l_partkey").alias("part"), "l_suppkey").agg(F.min(double(money("l_extendedprice")) / F.col("l_quantity")).alias("price"))
    best = offers.withColumn("least", F.min("price").over(Window.partitionBy("part"))).filter("price = least")
    rows = best.join(suppliers, F.col("l_suppkey") == F.col("s_suppkey")).select("s_acctbal", "s_name", "n_name", "part", "price")
    return rows.orderBy(F.desc("s_acctbal"), "n_name", "s_name", "part").limit(100)


_Q11 = "SELECT l_partkey, sum(CAST(l_extendedprice AS DECIMAL(14,2))) AS v FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey < 2 GROUP BY 1"


@query(f"WITH v AS ({_Q11}) SELECT l_partkey AS part, CAST(v AS DOUBLE) AS value FROM v WHERE v > (SELECT sum(v) * 0.0005 FROM v)")
def q11(spark, sf_dir):
    nations = frame(spark, sf_dir, "nation").filter("n_regionkey < 2")
    suppliers = frame(spark, sf_dir, "supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey"), "left_semi")
    items = frame(spark, sf_dir, "lineitem").join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"), "left_semi")
    values = items.groupBy("l_partkey").agg(F.sum(money("l_extendedprice")).alias("v"))
    least = values.agg((F.sum("v") * F.lit("0.0005").cast("decimal(5,4)")).alias("least"))  # one row
    return values.join(F.broadcast(least), F.col("v") > F.col("least")).select(F.col("l_partkey").alias("part"), double(F.col("v")).alias("value"))


@query("""SELECT l_returnflag, sum(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END)::BIGINT AS high, sum(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 0 ELSE 1 END)::BIGINT AS low
          FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_shipdate >= DATE '1997-01-01' AND l_shipdate < DATE '1998-01-01' AND datediff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) > 30 GROUP BY 1""")
def q12(spark, sf_dir):
    items = frame(spark, sf_dir, "lineitem").filter((F.col("l_shipdate") >= date("1997-01-01")) & (F.col("l_shipdate") < date("1998-01-01"))).select("l_orderkey", "l_returnflag", "l_shipdate")
    rows = items.join(frame(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_orderpriority"), F.col("l_orderkey") == F.col("o_orderkey"))
    late = rows.filter(sc.diff_days(F.col("o_orderdate"), F.col("l_shipdate")) > 30)
    high = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")
    return late.groupBy("l_returnflag").agg(F.count_if(high).alias("high"), F.count_if(~high).alias("low"))


@query("""SELECT p_brand, p_type, p_size, count(DISTINCT l_suppkey) AS suppliers FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_brand <> 'Brand#12' AND p_type NOT LIKE 'MEDIUM%' AND p_size IN (3, 9, 14, 19, 23, 36, 45, 49)
          AND l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0) GROUP BY 1, 2, 3""")
def q16(spark, sf_dir):
    parts = frame(spark, sf_dir, "part").filter((F.col("p_brand") != "Brand#12") & ~F.col("p_type").like("MEDIUM%") & F.col("p_size").isin(3, 9, 14, 19, 23, 36, 45, 49))
    bad = frame(spark, sf_dir, "supplier").filter("s_acctbal < 0").select("s_suppkey")
    items = frame(spark, sf_dir, "lineitem").select("l_partkey", "l_suppkey").join(bad, F.col("l_suppkey") == F.col("s_suppkey"), "left_anti")
    rows = items.join(parts.select("p_partkey", "p_brand", "p_type", "p_size"), F.col("l_partkey") == F.col("p_partkey"))
    return rows.groupBy("p_brand", "p_type", "p_size").agg(F.count_distinct("l_suppkey").alias("suppliers"))


@query("""SELECT s_suppkey, s_name FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_regionkey < 3 AND s_suppkey IN (
            SELECT l_suppkey FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_name LIKE 'red%') AND l_shipdate >= DATE '1997-01-01' AND l_shipdate < DATE '1998-01-01'
            GROUP BY l_partkey, l_suppkey HAVING sum(CAST(l_quantity AS DECIMAL(14,2))) > 20)""")
def q20(spark, sf_dir):
    parts = frame(spark, sf_dir, "part").filter(F.col("p_name").like("red%")).select("p_partkey")
    items = frame(spark, sf_dir, "lineitem").filter((F.col("l_shipdate") >= date("1997-01-01")) & (F.col("l_shipdate") < date("1998-01-01"))).join(parts, F.col("l_partkey") == F.col("p_partkey"), "left_semi")
    many = items.groupBy("l_partkey", "l_suppkey").agg(F.sum(money("l_quantity")).alias("q")).filter("q > 20")
    nations = frame(spark, sf_dir, "nation").filter("n_regionkey < 3").select("n_nationkey")
    suppliers = frame(spark, sf_dir, "supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey"), "left_semi")
    return suppliers.join(many, F.col("s_suppkey") == F.col("l_suppkey"), "left_semi").select("s_suppkey", "s_name")


_LATE = "datediff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) > 60"


@query(f"""WITH i AS (SELECT l_orderkey AS k, l_suppkey AS s, {_LATE} AS late FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_orderstatus = 'F')
           SELECT s_name, count(*) AS waits FROM i a JOIN supplier ON s_suppkey = a.s WHERE a.late AND EXISTS (SELECT 1 FROM i b WHERE b.k = a.k AND b.s <> a.s)
           AND NOT EXISTS (SELECT 1 FROM i b WHERE b.k = a.k AND b.s <> a.s AND b.late) GROUP BY 1 ORDER BY waits DESC, s_name LIMIT 100""")
def q21(spark, sf_dir):
    """Suppliers who alone held up an order of several: one pass over the orders' items."""
    orders = frame(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select("o_orderkey", "o_orderdate")
    items = frame(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey", "l_shipdate").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    late = sc.diff_days(F.col("o_orderdate"), F.col("l_shipdate")) > 60
    own = F.when(late, F.col("l_suppkey"))
    by_order = items.groupBy("l_orderkey").agg((F.min("l_suppkey") < F.max("l_suppkey")).alias("several"), F.min(own).alias("first"), F.max(own).alias("last"), F.count_if(late).alias("n"))
    alone = by_order.filter("several AND first = last").groupBy("first").agg(F.sum("n").alias("waits"))
    rows = alone.join(frame(spark, sf_dir, "supplier").select("s_suppkey", "s_name"), F.col("first") == F.col("s_suppkey"))
    return rows.groupBy("s_name").agg(F.sum("waits").alias("waits")).orderBy(F.desc("waits"), "s_name").limit(100)


@query("""SELECT c_nationkey, count(*) AS n, CAST(sum(CAST(c_acctbal AS DECIMAL(14,2))) AS DOUBLE) AS total FROM customer WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer WHERE c_acctbal > 0)
          AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderdate >= DATE '2001-07-01') GROUP BY 1""")
def q22(spark, sf_dir):
    customers = frame(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_acctbal")
    mean = customers.filter("c_acctbal > 0").agg(F.avg("c_acctbal").alias("m"))
    late = frame(spark, sf_dir, "orders").filter(F.col("o_orderdate") >= date("2001-07-01")).select("o_custkey")
    rich = customers.join(F.broadcast(mean), F.col("c_acctbal") > F.col("m"), "left_semi")  # one row
    return rich.join(late, F.col("o_custkey") == F.col("c_custkey"), "left_anti").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"), double(F.sum(money("c_acctbal"))).alias("total"))
