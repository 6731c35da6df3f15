"""Null ordering over all rows."""

import duckdb
from pyspark.sql import functions as F

from lakeloom.operators.windows import numbered
from lakeloom.plans.registry import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.1"


def test_nulls_come_last(spark):
    got = sorted(map(tuple, QUERIES["null_order_all"](spark, SF).collect()), key=lambda r: r[2])
    con = duckdb.connect()
    con.execute(f"CREATE VIEW customer AS FROM '{SF}/customer.parquet'")
    assert len(got) == 15000 and got[-1][1] is None and got == con.sql(ORACLE_SQL["null_order_all"] + " ORDER BY place").fetchall()


def test_numbered(spark):
    assert numbered(spark.range(0), [F.asc("id")], "place").collect() == []
    rows = numbered(spark.range(1000).repartition(7), [F.desc("id")], "place").collect()
    assert all(r.place == 1000 - r.id for r in rows) and len(rows) == 1000
