"""Queries: windows, sorting, set operations."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from lakeloom.operators.sampling import bernoulli
from lakeloom.operators.windows import numbered, top_n, unbounded
from lakeloom.plans.base import query


def _by_customer():
    return Window.partitionBy("o_custkey").orderBy("o_totalprice", "o_orderkey")


def _by_user():
    return Window.partitionBy("user_id").orderBy("ts", "event_id")


@query(
    """
    SELECT o_orderkey, row_number() OVER w AS rn, rank() OVER v AS rk, dense_rank() OVER v AS dr, ntile(4) OVER w AS nt
    FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey), v AS (PARTITION BY o_custkey ORDER BY o_orderpriority)"""
)
def window_ranks(t):
    v = Window.partitionBy("o_custkey").orderBy("o_orderpriority")
    long = lambda c, name: c.cast("long").alias(name)
    return t.orders.select("o_orderkey", long(F.row_number().over(_by_customer()), "rn"), long(F.rank().over(v), "rk"), long(F.dense_rank().over(v), "dr"), long(F.ntile(4).over(_by_customer()), "nt"))


@query("SELECT o_orderkey, round(percent_rank() OVER w, 9) AS pr, round(cume_dist() OVER w, 9) AS cd FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice)")
def window_distribution(t):
    w = Window.partitionBy("o_custkey").orderBy("o_totalprice")
    return t.orders.select("o_orderkey", F.round(F.percent_rank().over(w), 9).alias("pr"), F.round(F.cume_dist().over(w), 9).alias("cd"))


@query("SELECT event_id, lag(event_id, 1, -1) OVER w AS before, lead(event_id, 2, -1) OVER w AS after FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def window_offsets(t):
    return t.events.select("event_id", F.lag("event_id", 1, -1).over(_by_user()).alias("before"), F.lead("event_id", 2, -1).over(_by_user()).alias("after"))


@query(
    """
    SELECT event_id, first_value(event_id) OVER w AS f, last_value(event_id) OVER w AS l, nth_value(event_id, 3) OVER w AS n3
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"""
)
def window_values(t):
    w = unbounded(["user_id"], ["ts", "event_id"])
    return t.events.select("event_id", F.first("event_id").over(w).alias("f"), F.last("event_id").over(w).alias("l"), F.nth_value("event_id", 3).over(w).alias("n3"))


@query("SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS s3 FROM events")
def window_rows_frame(t):
    return t.events.select("event_id", F.round(F.sum("value").over(_by_user().rowsBetween(-2, 0)), 4).alias("s3"))


@query("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) AS day_events FROM events")
def window_range_frame(t):
    return t.sql("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) AS day_events FROM {events}", "events")


@query("SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) <= 3")
def top_per_group(t):
    return top_n(t.orders.select("o_custkey", "o_orderkey", "o_totalprice"), 3, ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")]).select("o_custkey", "o_orderkey")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def top_k(t):
    return t.orders.select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(10)


@query("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 10 OFFSET 100")
def offset(t):
    return t.orders.select("o_orderkey").orderBy("o_orderkey").offset(100).limit(10)


@query("SELECT c_custkey, k, CAST(row_number() OVER (ORDER BY k ASC NULLS LAST, c_custkey) AS BIGINT) AS place FROM (SELECT c_custkey, CASE WHEN c_acctbal > 9000 THEN c_acctbal END AS k FROM customer)")
def null_order_all(t):
    rows = t.customer.select("c_custkey", F.when(F.col("c_acctbal") > 9000, F.col("c_acctbal")).alias("k"))
    return numbered(rows, [F.asc_nulls_last("k"), F.asc("c_custkey")], "place")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE CAST('0x' || left(md5('0:' || o_orderkey), 7) AS BIGINT) < 0.1 * (1 << 28)")
def sample(t):
    return bernoulli(t.orders.select("o_orderkey", "o_custkey"), 0.1, ["o_orderkey"])


@query("SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier")
def union_all(t):
    return t.customer.select(F.col("c_nationkey").alias("k")).unionAll(t.supplier.select("s_nationkey"))


@query("SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def union_distinct(t):
    return t.customer.select(F.col("c_nationkey").alias("k")).union(t.supplier.select("s_nationkey")).distinct()


@query("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def intersect(t):
    return t.customer.select(F.col("c_nationkey").alias("k")).intersect(t.supplier.select("s_nationkey"))


@query("SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier")
def intersect_all(t):
    return t.customer.select(F.col("c_nationkey").alias("k")).intersectAll(t.supplier.select("s_nationkey"))


@query("SELECT c_custkey AS k FROM customer EXCEPT SELECT s_suppkey FROM supplier")
def except_distinct(t):
    return t.customer.select(F.col("c_custkey").alias("k")).subtract(t.supplier.select("s_suppkey"))


@query("SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier")
def except_all(t):
    return t.customer.select(F.col("c_nationkey").alias("k")).exceptAll(t.supplier.select("s_nationkey"))


@query("WITH v(k, name) AS (VALUES (1, 'one'), (2, 'two')) SELECT v.name, n_name FROM v JOIN nation ON n_nationkey = k")
def values_cte(t):
    return t.sql("WITH v(k, name) AS (VALUES (1, 'one'), (2, 'two')) SELECT v.name, n_name FROM v JOIN {nation} ON n_nationkey = k", "nation")


_MANAGERS = """
    WITH RECURSIVE r(k, top, depth, balance) AS (
        SELECT c_custkey, c_custkey, CAST(0 AS BIGINT), c_acctbal FROM {customer} WHERE c_custkey < 10
        UNION ALL SELECT c_custkey, top, depth + 1, c_acctbal FROM r JOIN {customer} ON c_custkey >= 10 AND c_custkey {div} 10 = k
    ) SELECT top, depth, count(*) AS n, round(sum(balance), 2) AS balance FROM r GROUP BY top, depth"""


@query(_MANAGERS.format(customer="customer", div="//"))
def recursive_cte(t):
    """A tree of customers, each below the one with its number less the last digit, level by level. Spark ends a recursion
    beyond a number of rows that is a setting, lifted here in a session beside this one, as depth bounds it."""
    session = t.spark.newSession()
    session.conf.set("spark.sql.cteRecursionRowLimit", -1)
    return type(t)(session, t.sf_dir).sql(_MANAGERS.replace("{div}", "div"), "customer")
