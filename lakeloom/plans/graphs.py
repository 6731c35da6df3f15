"""Queries: graphs of customers, suppliers and parts that order lines link."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakeloom.operators.graph import connected_components, ranks, triangles
from lakeloom.plans.base import query

ROUNDS = 12

_TRADES = "SELECT DISTINCT 3 * o_custkey AS c, 3 * l_suppkey + 1 AS s, 3 * l_partkey + 2 AS p FROM lineitem JOIN orders ON o_orderkey = l_orderkey"


def _trades(t):
    lines = t.lineitem.select(F.col("l_orderkey").alias("o_orderkey"), "l_suppkey", "l_partkey", "l_quantity")
    return lines.join(t.orders.select("o_orderkey", "o_custkey"), "o_orderkey")


@query(
    f"""
    WITH t AS ({_TRADES}), e AS (SELECT c AS a, s AS b FROM t UNION SELECT s, p FROM t UNION SELECT c, p FROM t),
    x AS (SELECT cs.a AS c, cs.b AS s, sp.b AS p FROM e cs JOIN e sp ON sp.a = cs.b AND cs.a % 3 = 0 AND cs.b % 3 = 1 AND sp.b % 3 = 2 JOIN e cp ON cp.a = cs.a AND cp.b = sp.b)
    SELECT node, count(*) AS triangles FROM (SELECT unnest([c, s, p]) AS node FROM x) GROUP BY node"""
)
def graph_triangles(t):
    """In how many triangles of a customer, a supplier and a part each lies."""
    c, s, p = 3 * F.col("o_custkey"), 3 * F.col("l_suppkey") + 1, 3 * F.col("l_partkey") + 2
    edges = _trades(t).select(F.explode(F.array(F.struct(c.alias("a"), s.alias("b")), F.struct(s.alias("a"), p.alias("b")), F.struct(c.alias("a"), p.alias("b")))).alias("e"))
    return triangles(edges.select("e.*"))


_STEP = """
    r{k} AS (
        SELECT r.node, (1 - 0.85) / m + 0.85 * (coalesce(g.got, 0) + lost / m) AS rank
        FROM r{j} r CROSS JOIN (SELECT count(*) AS m FROM v) CROSS JOIN (SELECT coalesce(sum(rank) FILTER (WHERE NOT EXISTS (SELECT 1 FROM w WHERE w.a = r{j}.node)), 0) AS lost FROM r{j})
        LEFT JOIN (SELECT b, sum(rank * share) AS got FROM r{j} JOIN w ON w.a = r{j}.node GROUP BY b) g ON g.b = r.node
    )"""


@query(
    f"""
    WITH e AS (
        SELECT 2 * o_custkey AS a, 2 * l_suppkey + 1 AS b, sum(l_quantity) AS w FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2
        UNION ALL SELECT 2 * l_suppkey + 1, 2 * o_custkey, sum(l_quantity) FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_suppkey % 10 > 0 GROUP BY 1, 2
    ), w AS MATERIALIZED (SELECT a, b, w / sum(w) OVER (PARTITION BY a) AS share FROM e), v AS MATERIALIZED (SELECT a AS node FROM e UNION SELECT b FROM e),
    r0 AS (SELECT node, 1.0::DOUBLE / (SELECT count(*) FROM v) AS rank FROM v),
    {",".join(_STEP.format(k=k, j=k - 1).replace(f"r{k} AS (", f"r{k} AS MATERIALIZED (") for k in range(1, ROUNDS + 1))}
    SELECT node, round(rank, 9) AS rank FROM r{ROUNDS}"""
)
def graph_ranks(t):
    """Customers and suppliers by damped ranking over what they trade; a tenth of the suppliers gives nothing on."""
    both = _trades(t).select((2 * F.col("o_custkey")).alias("c"), (2 * F.col("l_suppkey") + 1).alias("s"), F.col("l_quantity").alias("w"), (F.col("l_suppkey") % 10 > 0).alias("on"))
    # both directions from one pass, as the join below it would run twice otherwise
    there, back = F.struct(F.col("c").alias("a"), F.col("s").alias("b"), "w"), F.struct(F.col("s").alias("a"), F.col("c").alias("b"), "w")
    edges = both.select(F.explode(F.when(F.col("on"), F.array(there, back)).otherwise(F.array(there))).alias("e")).select("e.*")
    found, _ = ranks(edges, tolerance=0.0, rounds=ROUNDS)
    return found.select("node", F.round("rank", 9).alias("rank"))


@query(
    """
    WITH RECURSIVE e AS (SELECT DISTINCT o_custkey AS a, l_suppkey + 1000000000 AS b FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_quantity = 50 AND l_discount = 0.1 AND o_orderpriority = '1-URGENT'),
    u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
    r(node, m) AS (SELECT a, a FROM u UNION SELECT u.b, r.m FROM r JOIN u ON u.a = r.node)
    SELECT node, min(m) AS component FROM r GROUP BY node"""
)
def graph_components(t):
    """Groups of customers and suppliers that large, urgent, discounted order lines link."""
    orders = t.orders.filter("o_orderpriority = '1-URGENT'").select("o_orderkey", "o_custkey")
    lines = t.lineitem.filter("l_quantity = 50 AND l_discount = 0.1").select(F.col("l_orderkey").alias("o_orderkey"), "l_suppkey")
    return connected_components(lines.join(orders, "o_orderkey").select(F.col("o_custkey").alias("a"), (F.col("l_suppkey") + 1_000_000_000).alias("b")))
