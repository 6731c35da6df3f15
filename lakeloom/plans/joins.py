"""Queries: joins and subqueries."""

from pyspark.sql import functions as F

from lakeloom.operators.joins import asof_join, range_join, skewed_join
from lakeloom.plans.base import query
from lakeloom.sources.tables import write_bucketed


@query("SELECT o_orderkey, c_name, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey")
def join_inner(t):
    return t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name", "o_totalprice")


@query("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_orderstatus = 'F') ON c_custkey = o_custkey")
def join_left(t):
    return t.customer.join(t.orders.filter("o_orderstatus = 'F'"), F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "o_orderkey")


@query("SELECT s_suppkey, n_name FROM (SELECT * FROM supplier WHERE s_acctbal > 0) RIGHT JOIN nation ON s_nationkey = n_nationkey")
def join_right(t):
    return t.supplier.filter("s_acctbal > 0").join(t.nation, F.col("s_nationkey") == F.col("n_nationkey"), "right").select("s_suppkey", "n_name")


@query("SELECT c_custkey, s_suppkey FROM customer FULL JOIN supplier ON c_custkey = s_suppkey + 50")
def join_full(t):
    return t.customer.join(t.supplier, F.col("c_custkey") == F.col("s_suppkey") + 50, "full").select("c_custkey", "s_suppkey")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)")
def join_semi(t):
    return t.customer.join(t.orders, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def join_anti(t):
    return t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_orderkey")


@query("SELECT r_name, n_name FROM region CROSS JOIN nation")
def join_cross(t):
    # five by twenty-five rows, whatever the scale
    return t.region.crossJoin(t.nation).select("r_name", "n_name")


@query("SELECT a.n_nationkey AS low, b.n_nationkey AS high FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey")
def join_theta(t):
    a, b = t.nation.select(F.col("n_nationkey").alias("low")), t.nation.select(F.col("n_nationkey").alias("high"))
    return a.join(b, F.col("low") < F.col("high"))


@query("SELECT o_orderkey, s_suppkey FROM orders JOIN supplier ON o_totalprice BETWEEN s_acctbal AND s_acctbal + 25 WHERE s_acctbal > 0")
def join_range(t):
    bands = t.supplier.filter("s_acctbal > 0").select("s_suppkey", F.col("s_acctbal").alias("low"), (F.col("s_acctbal") + 25).alias("high"))
    return range_join(t.orders.select("o_orderkey", "o_totalprice"), bands, point="o_totalprice", low="low", high="high", width=50.0).select("o_orderkey", "s_suppkey")


@query(
    """
    WITH p AS (SELECT user_id, ts, max(value) AS spent FROM events WHERE event_type = 'purchase' GROUP BY 1, 2)
    SELECT e.event_id, p.spent FROM events e ASOF LEFT JOIN p ON e.user_id = p.user_id AND e.ts >= p.ts WHERE e.event_type = 'click'"""
)
def join_asof(t):
    bought = t.events.filter("event_type = 'purchase'").select("user_id", "ts", F.col("value").alias("spent"))
    clicks = t.events.filter("event_type = 'click'").select("event_id", "user_id", "ts")
    return asof_join(clicks, bought, on="ts", by=["user_id"], right_cols=["spent"]).select("event_id", "spent")


@query("SELECT o_orderstatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1")
def join_salted(t):
    lines = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_quantity")
    joined = skewed_join(lines, t.orders.select("o_orderkey", "o_orderstatus"), ["o_orderkey"], salts=4)
    return joined.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("SELECT o_orderkey, o_orderstatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 2")
def join_bucketed(t):
    """Both sides are written in buckets of the key once; the join and the aggregate then shuffle nothing."""
    orders = write_bucketed(t.orders.select("o_orderkey", "o_orderstatus"), ["o_orderkey"], 16)
    lines = write_bucketed(t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_quantity"), ["o_orderkey"], 16)
    joined = orders.hint("merge").join(lines, "o_orderkey")
    return joined.groupBy("o_orderkey", "o_orderstatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("SELECT c_custkey, m.best FROM customer, LATERAL (SELECT max(o_totalprice) AS best FROM orders WHERE o_custkey = c_custkey) m")
def subquery_lateral(t):
    return t.sql("SELECT c_custkey, m.best FROM {customer}, LATERAL (SELECT max(o_totalprice) AS best FROM {orders} WHERE o_custkey = c_custkey) m", "customer", "orders")


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT' AND o_totalprice > c_acctbal)")
def subquery_exists(t):
    return t.sql("SELECT c_custkey FROM {customer} WHERE EXISTS (SELECT 1 FROM {orders} WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT' AND o_totalprice > c_acctbal)", "customer", "orders")


@query("SELECT n_name FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM region WHERE r_regionkey < 3)")
def subquery_in(t):
    return t.sql("SELECT n_name FROM {nation} WHERE n_regionkey IN (SELECT r_regionkey FROM {region} WHERE r_regionkey < 3)", "nation", "region")


@query("SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.5 FROM orders)")
def subquery_scalar(t):
    return t.sql("SELECT o_orderkey FROM {orders} WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.5 FROM {orders})", "orders")
