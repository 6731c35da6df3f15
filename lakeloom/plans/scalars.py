"""Queries: scalar functions. Casts on both sides where engines type results differently."""

from pyspark.sql import functions as F

from lakeloom.functions.portable import day_of_week, ln, truncate, upper
from lakeloom.plans.base import query


def _long(c):
    return c.cast("long")


@query("SELECT c_custkey, upper(c_name) AS u, substring(c_name, 2, 4) AS s, reverse(c_name) AS r, replace(c_name, 'a', 'b') AS rp, lpad(c_name, 30, '*') AS lp, CAST(length(c_name) AS BIGINT) AS n FROM customer")
def strings(t):
    c = F.col("c_name")
    return t.customer.select("c_custkey", F.upper(c).alias("u"), F.substring(c, 2, 4).alias("s"), F.reverse(c).alias("r"), F.replace(c, F.lit("a"), F.lit("b")).alias("rp"), F.lpad(c, 30, "*").alias("lp"), _long(F.length(c)).alias("n"))


@query("SELECT p_partkey, upper(replace(p_name || 'ß', 'ß', 'ss')) AS u, lower(p_name) AS l FROM part")
def letter_case(t):
    return t.part.select("p_partkey", upper(F.concat("p_name", F.lit("ß"))).alias("u"), F.lower("p_name").alias("l"))


@query("SELECT c_custkey, trim('  ' || c_name || ' ') AS tr, string_split(c_name, '#') AS parts FROM customer")
def trim_split(t):
    return t.customer.select("c_custkey", F.trim(F.concat(F.lit("  "), "c_name", F.lit(" "))).alias("tr"), F.split("c_name", "#").alias("parts"))


@query("SELECT page_id, regexp_extract(url, '([0-9]+)', 1) AS num, regexp_replace(url, '[aeiou]', '_', 'g') AS masked, regexp_matches(url, '[0-9]$') AS ends FROM pages")
def regular_expressions(t):
    return t.pages.select("page_id", F.regexp_extract("url", "([0-9]+)", 1).alias("num"), F.regexp_replace("url", "[aeiou]", "_").alias("masked"), F.regexp_like("url", F.lit("[0-9]$")).alias("ends"))


@query("SELECT p_partkey, md5(p_name) AS m, sha256(p_name) AS s FROM part")
def digests(t):
    return t.part.select("p_partkey", F.md5("p_name").alias("m"), F.sha2("p_name", 256).alias("s"))


@query("SELECT a.n_name AS a, b.n_name AS b, CAST(levenshtein(a.n_name, b.n_name) AS BIGINT) AS d FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey")
def edit_distance(t):
    a, b = t.nation.select("n_regionkey", F.col("n_name").alias("a")), t.nation.select("n_regionkey", F.col("n_name").alias("b"))
    return a.join(b, "n_regionkey").select("a", "b", _long(F.levenshtein("a", "b")).alias("d"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def json_path(t):
    return t.events.select("event_id", F.get_json_object("props", "$.k").alias("k"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) + 1 AS k, '{\"k\":' || json_extract_string(props, '$.k') || '}' AS back FROM events")
def json_values(t):
    parsed = F.from_json("props", "k long")
    variant = F.variant_get(F.parse_json("props"), "$.k", "long")
    return t.events.select("event_id", (variant + 1).alias("k"), F.to_json(parsed).alias("back"))


@query(
    """
    SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, quarter(o_orderdate) AS q, dayofyear(o_orderdate) AS dy, weekofyear(o_orderdate) AS wk,
           last_day(o_orderdate) AS ld, CAST(o_orderdate + INTERVAL 2 MONTH AS DATE) AS am, date_trunc('month', o_orderdate) AS mt FROM orders"""
)
def dates(t):
    d = F.col("o_orderdate")
    parts = (("y", F.year), ("m", F.month), ("q", F.quarter), ("dy", F.dayofyear), ("wk", F.weekofyear))
    return t.orders.select("o_orderkey", *(_long(f(d)).alias(n) for n, f in parts), F.last_day(d).alias("ld"), F.add_months(d, 2).alias("am"), F.date_trunc("month", d).cast("timestamp_ntz").alias("mt"))


@query("SELECT o_orderkey, l_linenumber, datediff('day', o_orderdate, l_shipdate) AS days FROM orders JOIN lineitem ON o_orderkey = l_orderkey")
def date_difference(t):
    return t.orders.join(t.lineitem, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", "l_linenumber", _long(F.datediff("l_shipdate", "o_orderdate")).alias("days"))


@query("SELECT o_orderkey, CAST(dayofweek(o_orderdate) AS BIGINT) AS dow, strftime(o_orderdate, '%Y-%m') AS ym FROM orders")
def date_parts(t):
    return t.orders.select("o_orderkey", day_of_week(F.col("o_orderdate")).alias("dow"), F.date_format("o_orderdate", "yyyy-MM").alias("ym"))


@query("SELECT event_id, epoch_us(ts) AS us FROM events")
def epoch_micros(t):
    return t.events.select("event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))


@query("SELECT o_orderkey, (o_orderkey - 500) // 7 AS q, (o_orderkey - 500) % 7 AS r, round((o_orderkey - 500) / 7, 9) AS f FROM orders")
def arithmetic(t):
    x = F.col("o_orderkey") - 500
    return t.orders.select("o_orderkey", F.expr("(o_orderkey - 500) div 7").alias("q"), (x % 7).alias("r"), F.round(x / 7, 9).alias("f"))


@query("SELECT s_suppkey, round(s_acctbal, 1) AS r1, CAST(ceil(s_acctbal) AS BIGINT) AS c, CAST(floor(s_acctbal) AS BIGINT) AS f, round(s_suppkey + 0.5::DOUBLE) AS h FROM supplier")
def rounding(t):
    x = F.col("s_acctbal")
    return t.supplier.select("s_suppkey", F.round(x, 1).alias("r1"), F.ceil(x).alias("c"), F.floor(x).alias("f"), F.round(F.col("s_suppkey") + F.lit(0.5)).alias("h"))


@query("SELECT c_custkey, sqrt(abs(c_acctbal)) AS sq, round(ln(abs(c_acctbal) + 1), 9) AS l, power(c_custkey % 10, 2) AS p, CAST(sign(c_acctbal) AS INTEGER) AS sg FROM customer")
def mathematics(t):
    x = F.col("c_acctbal")
    return t.customer.select("c_custkey", F.sqrt(F.abs(x)).alias("sq"), ln(F.abs(x) + 1).alias("l"), F.pow(F.col("c_custkey") % 10, F.lit(2)).alias("p"), F.sign(x).cast("int").alias("sg"))


@query(
    """
    SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 5000 THEN 'some' ELSE 'much' END AS k,
           coalesce(nullif(c_nationkey, 0), -1) AS nk, c_name LIKE '%7' AS seven, c_nationkey IN (1, 2, 3) AS few FROM customer WHERE c_acctbal BETWEEN -500 AND 8000"""
)
def conditions(t):
    x = F.col("c_acctbal")
    case = F.when(x < 0, "debt").when(x < 5000, "some").otherwise("much")
    return t.customer.filter(x.between(-500, 8000)).select("c_custkey", case.alias("k"), F.coalesce(F.nullif(F.col("c_nationkey"), F.lit(0)), F.lit(-1)).alias("nk"), F.col("c_name").like("%7").alias("seven"), F.col("c_nationkey").isin(1, 2, 3).alias("few"))


@query("SELECT c_custkey, CAST(c_acctbal AS VARCHAR) AS txt, CAST(trunc(c_acctbal) AS BIGINT) AS whole FROM customer")
def casts(t):
    return t.customer.select("c_custkey", F.col("c_acctbal").cast("string").alias("txt"), truncate(F.col("c_acctbal")).alias("whole"))


@query("SELECT vec_id, unnest(embedding) AS x FROM embeddings")
def explode(t):
    return t.embeddings.select("vec_id", F.explode("embedding").alias("x"))


@query("SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * 2)), 6) AS twice, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))), 6) AS norm FROM embeddings")
def higher_order(t):
    e = F.transform("embedding", lambda x: x.cast("double"))
    total = lambda a: F.round(F.aggregate(a, F.lit(0.0), lambda s, x: s + x), 6)
    return t.embeddings.select("vec_id", total(F.transform(e, lambda x: x * 2)).alias("twice"), total(F.zip_with(e, e, lambda x, y: x * y)).alias("norm"))


@query("SELECT vec_id, list_max(embedding) AS m, CAST(len(list_distinct(embedding)) AS BIGINT) AS d, list_contains(embedding, embedding[1]) AS c, embedding[2:4] AS s FROM embeddings")
def arrays(t):
    e = F.col("embedding")
    return t.embeddings.select("vec_id", F.array_max(e).alias("m"), _long(F.size(F.array_distinct(e))).alias("d"), F.array_contains(e, F.element_at(e, 1)).alias("c"), F.slice(e, 2, 3).alias("s"))


@query("SELECT n_nationkey, n_name || '/' || n_regionkey AS both_, n_regionkey + 1 AS up FROM nation")
def maps_structs(t):
    rows = t.nation.select("n_nationkey", F.create_map(F.lit("r"), F.col("n_regionkey")).alias("m"), F.struct(F.col("n_name").alias("a"), F.col("n_regionkey").alias("b")).alias("s"))
    return rows.select("n_nationkey", F.concat("s.a", F.lit("/"), F.col("s.b").cast("string")).alias("both_"), (F.element_at("m", "r") + 1).alias("up"))


@query("SELECT page_id, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host FROM pages")
def url_parts(t):
    return t.pages.select("page_id", F.parse_url("url", F.lit("HOST")).alias("host"))
