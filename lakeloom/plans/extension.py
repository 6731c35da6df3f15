"""Queries: sources and sinks, and the ways to extend the engine.

Python functions get Arrow batches, but for `initials_by_row` and the table function, which show the interfaces by row."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeloom.plans.base import query
from lakeloom.sources.scratch import scratch
from lakeloom.sources.catalog import analysed, cost_based
from lakeloom.sources.derby import databases
from lakeloom.sources.row_groups import NAME, read_row_groups, use
from lakeloom.sources.tables import read, write
from lakeloom.sources.upsert import delete, merge, update


def _scratch(t) -> str:
    return scratch(t.spark, "io")


def _round_trip(t, format: str, schema: str | None = None, **options):
    nation = t.nation.select("n_nationkey", "n_name", "n_regionkey")
    path = _scratch(t)
    write(nation, path, format, **options)
    return read(t.spark, path, format, schema, **options).select("n_nationkey", "n_name", "n_regionkey")


_NATION = "SELECT n_nationkey, n_name, n_regionkey FROM nation"
_SCHEMA = "n_nationkey int, n_name string, n_regionkey int"


@query(_NATION)
def io_parquet(t):
    return _round_trip(t, "parquet")


@query(_NATION)
def io_orc(t):
    return _round_trip(t, "orc")


@query(_NATION)
def io_json(t):
    return _round_trip(t, "json", _SCHEMA)


@query(_NATION)
def io_csv(t):
    return _round_trip(t, "csv", _SCHEMA, header="true")


@query(_NATION)
def io_xml(t):
    return _round_trip(t, "xml", _SCHEMA, rowTag="nation")


@query("SELECT n_name AS value FROM nation")
def io_text(t):
    path = _scratch(t)
    write(t.nation.select("n_name"), path, "text")
    return read(t.spark, path, "text")


@query("SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1")
def io_partitioned(t):
    """The filter prunes the folders of other statuses."""
    path = _scratch(t)
    write(t.orders.select("o_orderkey", "o_orderstatus"), path, by=["o_orderstatus"])
    return read(t.spark, path).filter("o_orderstatus = 'F'").groupBy("o_orderstatus").agg(F.count("*").alias("n"))


@query("SELECT octet_length(encode(t)) AS size, sha256(t) AS digest FROM (SELECT string_agg(r_name || chr(10), '' ORDER BY r_name) AS t FROM region)")
def io_binary(t):
    """A text file's bytes, as they were written."""
    path = _scratch(t)
    write(t.region.select("r_name").coalesce(1).sortWithinPartitions("r_name"), path, "text")
    files = t.spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path)
    return files.select(F.octet_length("content").cast("long").alias("size"), F.sha2("content", 256).alias("digest"))


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem")
def io_noop(t):
    """Written to nowhere first, which runs the whole plan without a result."""
    rows = t.lineitem.select("l_orderkey", "l_linenumber", "l_quantity")
    write(rows, "", "noop", mode="overwrite")
    return rows


_BUSY = "SELECT event_id, ts, user_id, value FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND event_type IN ('purchase', 'signup') AND user_id < 50"


@query(_BUSY)
def io_custom_source(t):
    """A source in Python: filters are pushed down to row groups and rows."""
    rows = read_row_groups(t.spark, f"{t.sf_dir}/events.parquet")
    return _busy(rows)


def _busy(rows):
    chosen = rows.filter(F.col("ts") >= F.lit("2024-01-10").cast("timestamp_ntz")).filter(F.col("event_type").isin("purchase", "signup")).filter("user_id < 50")
    return chosen.select("event_id", "ts", "user_id", "value")


@query(_BUSY)
def io_custom_sink(t):
    """A sink in Python with commits, written twice and read back."""
    path = _scratch(t).removeprefix("file://")
    use(t.spark)
    for part in (F.col("event_id") % 3 == 0, F.col("event_id") % 3 != 0):
        t.events.filter(part).repartitionByRange(4, "ts").write.format(NAME).mode("append").save(path)
    return _busy(read_row_groups(t.spark, path))


@query("SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def io_custom_stream(t):
    """The source as a stream: what was read before is not read again when the stream goes on."""
    path = _scratch(t)
    table, state, out = (f"{path.removeprefix('file://')}/in", f"{path}/state", f"{path}/out")
    use(t.spark)
    for k in range(2):
        t.events.filter(F.col("event_id") % 2 == k).write.format(NAME).mode("append").save(table)
        rows = t.spark.readStream.format(NAME).load(table).select("event_id", "user_id", "event_type")
        rows.writeStream.format("parquet").option("checkpointLocation", state).trigger(availableNow=True).start(out).awaitTermination()
    return t.spark.read.parquet(out).groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


_ORDERS = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, year(o_orderdate) AS o_year FROM orders"


def _stored_orders(t) -> tuple[str, object]:
    path = _scratch(t)
    orders = t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", F.year("o_orderdate").cast("long").alias("o_year"))
    write(orders, path, by=["o_year"])
    return path, orders


@query(
    f"""
    WITH o AS ({_ORDERS})
    SELECT o_orderkey, o_custkey, CASE WHEN o_year >= 1999 AND o_orderkey % 10 = 0 THEN 'M' ELSE o_orderstatus END AS o_orderstatus, o_totalprice,
           CASE WHEN o_year >= 1999 AND o_orderkey % 20 = 0 THEN o_year + 1 ELSE o_year END AS o_year
    FROM o WHERE NOT (o_year >= 1999 AND o_orderkey % 10 = 1)
    UNION ALL SELECT o_orderkey + 1000000000, o_custkey, 'N', o_totalprice, o_year FROM o WHERE o_year >= 1999 AND o_orderkey % 10 = 2"""
)
def merge_orders(t):
    """Changed, moved, deleted and new rows of some years, merged into a stored table twice over, once in an earlier state."""
    path, orders = _stored_orders(t)
    some = orders.filter("o_year >= 1999")
    changed = some.filter("o_orderkey % 10 = 0").select("o_orderkey", "o_custkey", F.lit("M").alias("o_orderstatus"), "o_totalprice", F.expr("CASE WHEN o_orderkey % 20 = 0 THEN o_year + 1 ELSE o_year END").alias("o_year"), F.lit("upsert").alias("op"))
    gone = some.filter("o_orderkey % 10 = 1").withColumn("op", F.lit("delete"))
    new = some.filter("o_orderkey % 10 = 2").select((F.col("o_orderkey") + 1_000_000_000).alias("o_orderkey"), "o_custkey", F.lit("N").alias("o_orderstatus"), "o_totalprice", "o_year", F.lit(None).cast("string").alias("op"))
    latest = changed.unionByName(gone).unionByName(new).withColumn("at", F.lit(2))
    stale = latest.withColumn("o_totalprice", F.lit(0.0)).withColumn("op", F.lit(None).cast("string")).withColumn("at", F.lit(1))
    for _ in range(2):
        merge(t.spark, path, latest.unionByName(stale), ["o_orderkey"], "o_year", op="op", order="at")
    return t.spark.read.parquet(path).select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", F.col("o_year").cast("long").alias("o_year"))


@query(f"WITH o AS ({_ORDERS}) SELECT o_orderkey, o_custkey, CASE WHEN o_year = 1996 AND o_orderstatus = 'O' THEN 'X' ELSE o_orderstatus END AS o_orderstatus, o_totalprice, o_year FROM o WHERE NOT (o_year <= 1995 OR o_totalprice < 1000)")
def update_delete_orders(t):
    path, _ = _stored_orders(t)
    update(t.spark, path, F.expr("o_year = 1996 AND o_orderstatus = 'O'"), {"o_orderstatus": F.lit("X")}, "o_year")
    delete(t.spark, path, F.expr("o_year <= 1995 OR o_totalprice < 1000"), "o_year")
    return t.spark.read.parquet(path).select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", F.col("o_year").cast("long").alias("o_year"))


_FIVE = """
    SELECT r_name, p_type, count(*) AS n, round(sum(l_extendedprice), 2) AS price
    FROM {lineitem} JOIN {part} ON l_partkey = p_partkey JOIN {supplier} ON l_suppkey = s_suppkey JOIN {nation} ON s_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey
    WHERE p_size = 7 AND r_regionkey = 1 GROUP BY r_name, p_type"""


@query(_FIVE.replace("{", "").replace("}", ""))
def join_by_cost(t):
    """Five tables, joined in the order that their statistics make cheapest, not in the one written."""
    columns = {"lineitem": ["l_partkey", "l_suppkey"], "part": ["p_partkey", "p_size"], "supplier": ["s_suppkey", "s_nationkey"], "nation": ["n_nationkey", "n_regionkey"], "region": ["r_regionkey"]}
    names = {table: analysed(getattr(t, table), own) for table, own in columns.items()}
    return cost_based(t.spark).sql(_FIVE.format(**names))


@query("SELECT c_mktsegment, count(*) AS n, min(c_acctbal) AS low, max(c_acctbal) AS high FROM customer WHERE c_acctbal > 0 AND c_nationkey < 20 GROUP BY 1")
def io_jdbc(t):
    """The customers in databases that tasks load, which filter and aggregate; their results are put together."""
    found = [
        rows.filter("c_acctbal > 0 AND c_nationkey < 20").groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.min("c_acctbal").alias("low"), F.max("c_acctbal").alias("high"))
        for rows in databases(t.customer, "CUSTOMER")
    ]
    return reduce(DataFrame.unionAll, found).groupBy("c_mktsegment").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))


@F.pandas_udf(T.DoubleType())
def with_tax(price: pd.Series, tax: pd.Series) -> pd.Series:
    return price * (1 + tax)


@query("SELECT l_returnflag, round(sum(l_extendedprice * (1 + l_tax)), 2) AS gross FROM lineitem GROUP BY 1")
def udf_vectorised(t):
    return t.lineitem.groupBy("l_returnflag").agg(F.round(F.sum(with_tax("l_extendedprice", "l_tax")), 2).alias("gross"))


@F.arrow_udf(T.StringType())
def initials(name: pa.Array) -> pa.Array:
    return pc.binary_join_element_wise(pc.utf8_slice_codeunits(name, 0, 1), pc.utf8_slice_codeunits(name, -1), "")


@F.udf(T.StringType(), useArrow=True)
def initials_by_row(name: str | None) -> str | None:
    return None if name is None else name[:1] + name[-1:]


@query("SELECT c_custkey, left(c_name, 1) || right(c_name, 1) AS i FROM customer")
def udf_arrow(t):
    return t.customer.select("c_custkey", initials("c_name").alias("i"))


@query("SELECT c_custkey, left(c_name, 1) || right(c_name, 1) AS i FROM customer")
def udf_row(t):
    """The interface by row, with Arrow for the transfer alone."""
    return t.customer.select("c_custkey", initials_by_row("c_name").alias("i"))


@F.pandas_udf(T.DoubleType())
def lowest(x: pd.Series) -> float:
    return float(x.min())


@F.pandas_udf(T.DoubleType())
def highest(x: pd.Series) -> float:
    return float(x.max())


@query("SELECT event_type, max(value) - min(value) AS s FROM events GROUP BY 1")
def udaf(t):
    """Aggregates in Python have no partial step of their own and get whole groups, so groups are cut first, into as many
    parts as keep each at some 10,000 rows if one group has them all."""
    part = F.pmod(F.xxhash64("event_id"), F.lit(max(1, t.events.count() // 10_000))).alias("part")
    parts = t.events.groupBy("event_type", part).agg(lowest("value").alias("low"), highest("value").alias("high"))
    return parts.groupBy("event_type").agg(lowest("low").alias("low"), highest("high").alias("high")).select("event_type", (F.col("high") - F.col("low")).alias("s"))


@F.udtf(returnType=T.StructType().add("n_nationkey", T.IntegerType()).add("k", T.IntegerType()))
class _Repeat:
    def eval(self, row: Row):
        for k in range(row["n_regionkey"] + 1):
            yield row["n_nationkey"], k


@query("SELECT n_nationkey, CAST(unnest(range(n_regionkey + 1)) AS INTEGER) AS k FROM nation")
def udtf(t):
    return _Repeat(t.nation.select("n_nationkey", "n_regionkey").asTable())


@query("SELECT user_id, count(*) AS n, round(max(value) - min(value), 6) AS s FROM events GROUP BY 1")
def grouped_map(t):
    """A group arrives in batches, of which one is held at a time."""

    def one(key: tuple, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, low, high = 0, float("inf"), float("-inf")
        for rows in batches:
            n, low, high = n + len(rows), min(low, rows.value.min()), max(high, rows.value.max())
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "s": [round(high - low, 6)]})

    return t.events.select("user_id", "value").groupBy("user_id").applyInPandas(one, "user_id long, n long, s double")


@query("SELECT k, (SELECT count(*) FROM customer WHERE c_nationkey = k) AS customers, (SELECT count(*) FROM supplier WHERE s_nationkey = k) AS suppliers FROM (SELECT DISTINCT c_nationkey AS k FROM customer)")
def cogrouped_map(t):
    """Both groups of a key are held by one worker, so what reaches it are at most 16 partial counts a key and side."""

    def both(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"k": [a.k.iloc[0]], "customers": [a.n.sum()], "suppliers": [b.n.sum()]}) if len(a) else pd.DataFrame({"k": [], "customers": [], "suppliers": []})

    def counts(rows, key: str, of: str):
        return rows.groupBy(F.col(key).alias("k"), F.pmod(F.xxhash64(of), F.lit(16)).alias("part")).agg(F.count("*").alias("n")).select("k", "n")

    a, b = counts(t.customer, "c_nationkey", "c_custkey"), counts(t.supplier, "s_nationkey", "s_suppkey")
    return a.groupBy("k").cogroup(b.groupBy("k")).applyInPandas(both, "k int, customers long, suppliers long")


@query("SELECT o_orderkey, upper(o_orderstatus) || '!' AS s FROM orders WHERE o_totalprice > 1000")
def batch_map(t):
    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pc.binary_join_element_wise(pc.utf8_upper(b.column(1)), "!", "")], ["o_orderkey", "s"])

    return t.orders.filter("o_totalprice > 1000").select("o_orderkey", "o_orderstatus").mapInArrow(some, "o_orderkey long, s string")


@query("SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS net FROM lineitem")
def sql_function(t):
    t.spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION net_price(price DOUBLE, discount DOUBLE) RETURNS DOUBLE RETURN price * (1 - discount)")
    return t.sql("SELECT l_orderkey, l_linenumber, round(net_price(l_extendedprice, l_discount), 4) AS net FROM {lineitem}", "lineitem")
