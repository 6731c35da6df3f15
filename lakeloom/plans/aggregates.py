"""Queries: aggregation."""

from pyspark.sql import functions as F

from lakeloom.functions.portable import sum_of
from lakeloom.operators import sketches as sk
from lakeloom.operators.windows import exact_quantiles
from lakeloom.plans.base import query
from lakeloom.sources.scratch import materialise, scratch


@query(
    """
    SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty,
           round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price,
           round(avg(l_extendedprice), 4) AS avg_price, count(*) AS count_order
    FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2"""
)
def pricing_summary(t):
    lines = t.lineitem.filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
    price = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return lines.groupBy("l_returnflag", "l_linestatus").agg(sum_of(F.col("l_quantity")).alias("sum_qty"), sum_of(price).alias("sum_disc_price"), F.round(F.avg("l_extendedprice"), 4).alias("avg_price"), F.count("*").alias("count_order"))


@query("SELECT o_orderstatus, min(o_totalprice) AS low, max(o_totalprice) AS high, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def group_by(t):
    x = F.col("o_totalprice")
    return t.orders.groupBy("o_orderstatus").agg(F.min(x).alias("low"), F.max(x).alias("high"), F.count("*").alias("n"), sum_of(x).alias("total"))


@query("SELECT l_returnflag, CAST(sum(CAST(l_extendedprice AS DECIMAL(12,2))) AS DECIMAL(22,2)) AS total FROM lineitem GROUP BY 1")
def decimal_sum(t):
    return t.lineitem.groupBy("l_returnflag").agg(F.sum(F.col("l_extendedprice").cast("decimal(12,2)")).cast("decimal(22,2)").alias("total"))


@query("SELECT event_type, count(DISTINCT user_id) AS users, count(DISTINCT props) AS kinds FROM events GROUP BY 1")
def count_distinct(t):
    return t.events.groupBy("event_type").agg(F.count_distinct("user_id").alias("users"), F.count_distinct("props").alias("kinds"))


@query("SELECT o_orderstatus, count(DISTINCT o_custkey) AS exact, true AS near FROM orders GROUP BY 1")
def approx_distinct(t):
    """The exact number, and whether the sketch is within five standard errors of it; the sketch itself differs by engine."""
    both = t.orders.groupBy("o_orderstatus").agg(F.approx_count_distinct("o_custkey", 0.02).alias("a"), F.count_distinct("o_custkey").alias("exact"))
    return both.select("o_orderstatus", "exact", (F.abs(F.col("a") - F.col("exact")) <= 0.1 * F.col("exact")).alias("near"))


_STORED = "o_year int, o_month int, o_orderpriority string, n long, hll binary, theta binary, kll binary"


def _sketches(t):
    """Orders' sketches by month and priority, stored by year: two loads, of which the second brings one year anew."""
    path = scratch(t.spark, "sketches")
    orders = t.orders.select(F.year("o_orderdate").alias("o_year"), F.month("o_orderdate").alias("o_month"), "o_orderpriority", "o_custkey", "o_totalprice")
    for some in (orders.filter("o_year <= 1998"), orders.filter("o_year >= 1998")):
        sk.store(sk.sketched(some, ["o_year", "o_month", "o_orderpriority"], "o_custkey", "o_totalprice"), path, "o_year")
    return sk.stored(t.spark, path, _STORED)


@query(
    """
    WITH o AS (SELECT year(o_orderdate) AS y, * FROM orders),
    a AS (SELECT y, o_orderpriority, count(*) AS n, count(DISTINCT o_custkey) AS exact FROM o GROUP BY GROUPING SETS ((y, o_orderpriority), (y), ()))
    SELECT y AS o_year, o_orderpriority, n, exact, true AS near, true AS near_median, true AS near_p99 FROM a"""
)
def sketch_rollup(t):
    """Sketches by month and priority, merged to year and priority, to years and to one: against the exact numbers, whether
    distinct customers are within four standard errors, and whether quantiles' true ranks are within the rank error."""
    month = _sketches(t)
    levels = [sk.merged(month, ["o_year", "o_orderpriority"]), sk.merged(month, ["o_year"]).withColumn("o_orderpriority", F.lit(None).cast("string")), sk.merged(month, []).withColumns({"o_year": F.lit(None).cast("int"), "o_orderpriority": F.lit(None).cast("string")})]
    told = None
    for level in levels:
        found = sk.estimates(level, {"median": 0.5, "p99": 0.99}).select("o_year", "o_orderpriority", "n", "distinct", "median", "p99")
        told = found if told is None else told.unionByName(found)
    told = materialise(told, "estimates")
    orders = t.orders.select(F.year("o_orderdate").alias("y"), F.col("o_orderpriority").alias("p"), "o_custkey", "o_totalprice")
    # each order belongs to a group of each level, whose estimates (a row a group) it meets
    level = F.explode(F.array(F.struct("y", "p"), F.struct("y", F.lit(None).cast("string").alias("p")), F.struct(F.lit(None).cast("int").alias("y"), F.lit(None).cast("string").alias("p")))).alias("g")
    each = orders.select(level, "o_custkey", "o_totalprice").select("g.y", "g.p", "o_custkey", "o_totalprice")
    same = F.col("o_year").eqNullSafe(F.col("y")) & F.col("o_orderpriority").eqNullSafe(F.col("p"))
    share = lambda c: F.avg((F.col("o_totalprice") <= F.col(c)).cast("double")).alias(f"at_{c}")
    exact = each.join(told, same).groupBy("o_year", "o_orderpriority", "n", "distinct").agg(F.count_distinct("o_custkey").alias("exact"), share("median"), share("p99"))
    near = F.abs(F.col("distinct") - F.col("exact")) <= F.greatest(sk.DISTINCT_ERROR * F.col("exact"), F.lit(1.0))
    # a group of few rows has steps of 1 / n
    close = lambda c, q: F.abs(F.col(c) - q) <= sk.RANK_ERROR + 1 / F.col("n")
    return exact.select("o_year", "o_orderpriority", "n", "exact", near.alias("near"), close("at_median", 0.5).alias("near_median"), close("at_p99", 0.99).alias("near_p99"))


@query(
    """
    WITH c AS (SELECT DISTINCT year(o_orderdate) AS y, o_custkey FROM orders), n AS (SELECT y, count(*) AS n FROM c GROUP BY y)
    SELECT a.y AS a, b.y AS b, count(*) AS common, true AS near FROM c a JOIN c b ON a.o_custkey = b.o_custkey AND a.y < b.y GROUP BY 1, 2"""
)
def sketch_overlap(t):
    """Customers whom two years have in common, by theta sketches of months merged to years: whether estimates are near."""
    told = sk.in_common(sk.merged(_sketches(t), ["o_year"]), "o_year")
    customers = t.orders.select(F.year("o_orderdate").alias("y"), "o_custkey").distinct()
    years = customers.groupBy("o_custkey").agg(F.array_sort(F.collect_list("y")).alias("ys"))  # a customer has a row a year at most
    pairs = years.select(F.posexplode("ys").alias("i", "a"), "ys").select("a", F.explode(F.slice("ys", F.col("i") + 2, F.size("ys"))).alias("b"))
    exact = pairs.groupBy("a", "b").agg(F.count("*").alias("common"))
    both = exact.join(told.withColumnRenamed("common", "estimate"), ["a", "b"])
    return both.select("a", "b", "common", (F.abs(F.col("estimate") - F.col("common")) <= sk.COMMON_ERROR * F.col("either") + 1).alias("near"))


@query("SELECT n_regionkey, n_nationkey % 3 AS k, count(*) AS n, CAST(grouping(n_regionkey) AS BIGINT) AS g FROM nation GROUP BY ROLLUP (n_regionkey, n_nationkey % 3)")
def rollup(t):
    rows = t.nation.select("n_regionkey", (F.col("n_nationkey") % 3).alias("k"))
    return rows.rollup("n_regionkey", "k").agg(F.count("*").alias("n"), F.grouping("n_regionkey").cast("long").alias("g"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def cube(t):
    return t.orders.cube("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())")
def grouping_sets(t):
    return t.lineitem.groupingSets([["l_returnflag"], ["l_linestatus"], []], "l_returnflag", "l_linestatus").agg(F.count("*").alias("n"))


@query("SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus = 'F') AS done, round(sum(o_totalprice) FILTER (WHERE o_orderstatus = 'O'), 2) AS open_total FROM orders GROUP BY 1")
def filtered_aggregate(t):
    return t.orders.groupBy("o_custkey").agg(F.count_if(F.col("o_orderstatus") == "F").alias("done"), sum_of(F.when(F.col("o_orderstatus") == "O", F.col("o_totalprice"))).alias("open_total"))


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) > 15")
def having(t):
    return t.orders.groupBy("o_custkey").agg(F.count("*").alias("n")).filter("n > 15")


@query("SELECT event_type, round(stddev_samp(value), 6) AS sd, round(var_pop(value), 6) AS vp, round(corr(value, user_id), 6) AS c, round(regr_slope(value, user_id), 6) AS slope FROM events GROUP BY 1")
def statistics(t):
    v, u = F.col("value"), F.col("user_id")
    return t.events.groupBy("event_type").agg(F.round(F.stddev_samp(v), 6).alias("sd"), F.round(F.var_pop(v), 6).alias("vp"), F.round(F.corr(v, u), 6).alias("c"), F.round(F.regr_slope(v, u), 6).alias("slope"))


@query("SELECT event_type, round(quantile_cont(value, 0.9), 6) AS p90, round(median(value), 6) AS mid FROM events GROUP BY 1")
def percentiles(t):
    """Exact; a group's values are spread over tasks, as five groups hold the whole table."""
    found = exact_quantiles(t.events, ["event_type"], "value", {"p90": 0.9, "mid": 0.5})
    return found.select("event_type", F.round("p90", 6).alias("p90"), F.round("mid", 6).alias("mid"))


@query("SELECT l_returnflag, round(quantile_cont(l_quantity, 0.25), 6) AS q1, round(median(l_quantity), 6) AS mid FROM lineitem GROUP BY 1")
def percentile_aggregate(t):
    """With the built-in aggregate, which holds a count of each distinct value: for columns of few values, as here fifty."""
    return t.lineitem.groupBy("l_returnflag").agg(F.round(F.percentile("l_quantity", 0.25), 6).alias("q1"), F.round(F.median("l_quantity"), 6).alias("mid"))


@query(
    """
    SELECT event_type, round((avg(value ** 3) - 3 * avg(value) * avg(value ** 2) + 2 * avg(value) ** 3) / var_pop(value) ** 1.5, 5) AS skew,
           round(kurtosis_pop(value), 5) AS kurt FROM events GROUP BY 1"""
)
def moments(t):
    """Skewness and excess kurtosis of the population."""
    return t.events.groupBy("event_type").agg(F.round(F.skewness("value"), 5).alias("skew"), F.round(F.kurtosis("value"), 5).alias("kurt"))


@query("SELECT event_type, bool_or(value > 490) AS any_high, min(event_id) FILTER (WHERE value = top) AS top_event FROM (SELECT *, max(value) OVER (PARTITION BY event_type) AS top FROM events) GROUP BY 1")
def extremes(t):
    """Of events with the largest value the one with the smallest id."""
    first = F.max_by("event_id", F.struct("value", -F.col("event_id")))
    return t.events.groupBy("event_type").agg(F.bool_or(F.col("value") > 490).alias("any_high"), first.alias("top_event"))


@query("SELECT o_custkey, bit_and(o_orderkey) AS a, bit_or(o_orderkey) AS o, bit_xor(o_orderkey) AS x FROM orders GROUP BY 1")
def bit_aggregates(t):
    return t.orders.groupBy("o_custkey").agg(F.bit_and("o_orderkey").alias("a"), F.bit_or("o_orderkey").alias("o"), F.bit_xor("o_orderkey").alias("x"))


@query("SELECT n_regionkey, list(n_nationkey ORDER BY n_nationkey) AS keys FROM nation GROUP BY 1")
def list_aggregate(t):
    return t.nation.groupBy("n_regionkey").agg(F.array_sort(F.collect_list("n_nationkey")).alias("keys"))


@query("SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY 1")
def string_aggregate(t):
    return t.sql("SELECT n_regionkey, listagg(n_name, ',') WITHIN GROUP (ORDER BY n_name) AS names FROM {nation} GROUP BY 1", "nation")


@query("SELECT user_id, count(*) FILTER (WHERE event_type = 'click') AS click, count(*) FILTER (WHERE event_type = 'view') AS view FROM events GROUP BY 1")
def pivot(t):
    return t.events.groupBy("user_id").pivot("event_type", ["click", "view"]).agg(F.count("event_id")).fillna(0, ["click", "view"])


@query("SELECT o_orderkey, 'status' AS field, o_orderstatus AS v FROM orders UNION ALL SELECT o_orderkey, 'priority', o_orderpriority FROM orders")
def unpivot(t):
    rows = t.orders.select("o_orderkey", F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority"))
    return rows.unpivot("o_orderkey", ["status", "priority"], "field", "v")


@query(
    """
    SELECT lang, quality, toxic, count(*) AS n, round(avg(n_chars), 4) AS mean_chars, round(avg(length(text)), 4) AS mean_length
    FROM documents JOIN labels USING (doc_id) GROUP BY 1, 2, 3"""
)
def label_averages(t):
    """Texts are measured below the join, so only their lengths travel."""
    docs = t.documents.select("doc_id", "lang", "n_chars", F.char_length("text").alias("length"))
    return docs.join(t.labels, "doc_id").groupBy("lang", "quality", "toxic").agg(F.count("*").alias("n"), F.round(F.avg("n_chars"), 4).alias("mean_chars"), F.round(F.avg("length"), 4).alias("mean_length"))
