"""The Python source and sink, merges, statistics and JDBC: what is pushed down, what is rewritten, what a failure leaves."""

import os
import re
import subprocess
import sys
from functools import reduce
from pathlib import Path

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.plans.base import Tables
from lakeloom.plans.registry import ORACLE_SQL, QUERIES
from lakeloom.sources import catalog, derby, row_groups, upsert
from lakeloom.sources.scratch import release
from lakeloom.sources.tables import write, write_bucketed

SF = "/root/testdata/sf0.001"


def plan(df):
    df.collect()
    return df._jdf.queryExecution().toString()


@pytest.fixture()
def grouped(spark, tmp_path):
    """Two files of ten row groups each."""
    rows = spark.range(2000).select("id", (F.col("id") % 7).alias("k"), F.when(F.col("id") % 5 > 0, F.concat(F.lit("t"), "id")).alias("t"), (F.col("id") / 3).alias("x")).toPandas()
    for n in range(2):
        part = pa.Table.from_pandas(rows[n * 1000 : (n + 1) * 1000], preserve_index=False)
        pq.write_table(part, tmp_path / f"{n}.parquet", row_group_size=100)
    return str(tmp_path)


@pytest.mark.parametrize(
    "condition, groups",
    [("id = 777", 1), ("id > 1850 AND k = 3", 2), ("id IN (5, 6, 1999)", 2), ("id >= 150 AND id < 300 AND t IS NOT NULL", 2), ("t = 't101'", None), ("x < 10", None), ("k IS NULL", None), ("id = 5 OR k = 2", None), ("t LIKE 't19%'", None), ("id <> 3", None), ("id > 5000", 0)],
)
def test_filters_reach_row_groups(spark, grouped, condition, groups):
    found = row_groups.read_row_groups(spark, grouped).filter(condition)
    want = spark.read.parquet(grouped).filter(condition)
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    if groups is not None:
        assert found.rdd.getNumPartitions() == max(1, groups)
        # no filter of Spark's own is left
        assert not re.search(r"^\W*(?:\(\d+\) )?Filter ", plan(found).partition("== Physical Plan ==")[2], re.MULTILINE)


def test_pushed_filters_are_in_the_plan(spark):
    text = plan(QUERIES["io_custom_source"](spark, SF)).partition("== Physical Plan ==")[2]
    assert "BatchScan row_groups" in text and not re.search(r"^\W*(?:\(\d+\) )?Filter ", text, re.MULTILINE)


def test_a_failed_write_leaves_no_rows(spark, tmp_path):
    row_groups.use(spark)
    path = str(tmp_path / "t")
    spark.range(10).write.format("row_groups").mode("append").save(path)
    boom = F.udf(lambda x: x if x < 900 else 1 // 0, "long")
    with pytest.raises(PySparkException):
        spark.range(1000).repartition(4).select(boom("id").alias("id")).write.format("row_groups").mode("append").save(path)
    assert row_groups.read_row_groups(spark, path).count() == 10
    left = [f for f in os.listdir(path) if f.endswith(".parquet")]
    listed = [f.rpartition("/")[2] for f in row_groups._files(path)]
    assert sorted(left) == sorted(listed)
    # a file that no commit lists isn't read
    pq.write_table(pq.read_table(f"{path}/{left[0]}"), f"{path}/stray.parquet")
    assert row_groups.read_row_groups(spark, path).count() == 10
    spark.range(3).write.format("row_groups").mode("overwrite").save(path)
    assert row_groups.read_row_groups(spark, path).count() == 3


def test_stream_goes_on_where_it_was(spark, tmp_path):
    row_groups.use(spark)
    path, counts = str(tmp_path / "t"), []
    for k in range(3):
        spark.range(k * 100, k * 100 + 100).write.format("row_groups").mode("append").save(path)
        query = spark.readStream.format("row_groups").load(path).writeStream.foreachBatch(lambda df, n: counts.append(df.count())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        query.awaitTermination()
    assert [c for c in counts if c] == [100, 100, 100]


def files(path):
    return {str(p): p.stat().st_mtime_ns for p in Path(path).rglob("*.parquet")}


def test_merge_rewrites_touched_partitions_only(spark, tmp_path):
    path = str(tmp_path / "t")
    write(spark.range(100).select("id", (F.col("id") * 10).alias("v"), F.when(F.col("id") < 90, (F.col("id") % 5).cast("int")).alias("p")), path, by=["p"])
    before = files(path)
    schema = "id long, v long, p int, op string, at int"
    changes = spark.createDataFrame([(0, 1, 0, "upsert", 1), (0, 2, 0, "upsert", 2), (5, 0, 0, "delete", 1), (1, 7, 2, None, 1), (500, 5, 9, None, 1), (501, 5, 9, "delete", 1), (502, 5, 9, None, 1), (502, 5, 9, "delete", 2), (95, 1, None, None, 1)], schema)
    for _ in range(2):
        upsert.merge(spark, path, changes, ["id"], "p", op="op", order="at")
        got = {r.id: (r.v, r.p) for r in spark.read.parquet(path).collect()}
        want = {i: (i * 10, i % 5 if i < 90 else None) for i in range(100) if i != 5} | {0: (2, 0), 1: (7, 2), 500: (5, 9), 95: (1, None)}
        assert got == want
    after = files(path)
    same = {f for f in before if before[f] == after.get(f)}
    assert {Path(f).parent.name for f in same} == {"p=3", "p=4"}
    # all rows of a partition go, and with them its folder
    upsert.merge(spark, path, spark.createDataFrame([(500, 0, 9, "delete", 1)], schema), ["id"], "p", op="op")
    assert not os.path.exists(f"{path}/p=9") and spark.read.parquet(path).count() == 99
    upsert.merge(spark, path, changes.limit(0), ["id"], "p", op="op", order="at")
    assert spark.read.parquet(path).count() == 99


def test_update_and_delete(spark, tmp_path):
    path = str(tmp_path / "t")
    write(spark.range(60).select("id", F.when(F.col("id") % 2 == 0, F.col("id")).alias("v"), (F.col("id") % 3).cast("int").alias("p")), path, by=["p"])
    before = files(path)
    for _ in range(2):
        upsert.update(spark, path, F.expr("v > 40 AND p = 1"), {"v": F.lit(-1), "p": F.lit(2)}, "p")
        upsert.delete(spark, path, F.expr("v < 10 AND p = 1"), "p")
    got = {r.id: (r.v, r.p) for r in spark.read.parquet(path).collect()}
    own = {i: (i if i % 2 == 0 else None, i % 3) for i in range(60)}
    want = {i: ((-1, 2) if p == 1 and v is not None and v > 40 else (v, p)) for i, (v, p) in own.items() if not (p == 1 and v is not None and v < 10)}
    assert got == want
    assert {Path(f).parent.name for f, t in before.items() if files(path).get(f) == t} == {"p=0"}


def test_joins_are_ordered_by_cost(spark):
    found = QUERIES["join_by_cost"](spark, SF)
    text = found._jdf.queryExecution().optimizedPlan().toString()
    # the filtered part table meets the order lines before suppliers do; as written the nations come last
    order = [line for line in text.splitlines() if "Relation" in line]
    names = ["part" if "p_partkey" in x else "lineitem" if "l_partkey" in x else "supplier" if "s_suppkey" in x else "nation" if "n_nationkey" in x else "region" for x in order]
    depth = {n: len(x) - len(x.lstrip(" :+-")) for n, x in zip(names, order)}
    assert set(names) == {"part", "lineitem", "supplier", "nation", "region"}
    plain = spark.newSession()
    assert plain.conf.get("spark.sql.cbo.joinReorder.enabled") == "false"
    tables = {n: getattr(Tables(plain, SF), n) for n in names}
    from lakeloom.plans.extension import _FIVE

    before = plain.sql(_FIVE, **tables)._jdf.queryExecution().optimizedPlan().toString()
    shape = lambda t: [("part" if "p_partkey" in x else "lineitem" if "l_partkey" in x else "supplier" if "s_suppkey" in x else "nation" if "n_nationkey" in x else "region") for x in t.splitlines() if "Relation" in x]
    assert shape(before) == ["lineitem", "part", "supplier", "nation", "region"] and names != shape(before), (names, depth)


def test_tables_of_the_catalogue_are_dropped(spark):
    catalog.analysed(spark.range(5), ["id"])
    write_bucketed(spark.range(5), ["id"], 2).count()
    names = {r.tableName for r in spark.sql("SHOW TABLES").collect()}
    assert any(n.startswith("analysed_") for n in names) and any(n.startswith("bucketed_") for n in names)
    release(spark)
    assert not [r for r in spark.sql("SHOW TABLES").collect() if r.tableName.startswith(("analysed_", "bucketed_"))]


def test_jdbc_takes_over_filters_and_aggregates(spark):
    text = plan(QUERIES["io_jdbc"](spark, SF))
    assert "PushedAggregates: [COUNT(*), MIN(C_ACCTBAL), MAX(C_ACCTBAL)]".lower() in text.lower() and "PushedFilters" in text and "PushedGroupByExpressions" in text


def test_derby_holds_rows_in_several_databases(spark):
    """What CSV and SQL could mistake comes back as it was, from databases that any process may open."""
    texts = [None, "", " a ", 'q"u,o\'te', "line\nbreak\r\n", "Ünïcödé 漢字 🎉", "NULL", "\\", "x" * 200_000, "漢" * 70_000, "a;b"]
    rows = [(i, i % 7 or None, i / 8 if i % 3 else None, texts[i % len(texts)]) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, `key of` int, share double, text string")
    parts = derby.databases(df, "ODD", rows=200)
    assert len(parts) == 3 and all(p.count() for p in parts)
    assert sorted(map(tuple, reduce(DataFrame.unionAll, parts).collect()), key=lambda r: r[0]) == rows
    (none,) = derby.databases(df.limit(0), "ODD")
    assert none.collect() == []
    with pytest.raises(Exception, match="Derby: ERROR"):  # what it can't hold is an error
        derby.databases(spark.createDataFrame([(float("nan"),)], "share double"), "ODD")


_ON_A_CLUSTER = """
import sys
from pyspark.sql import SparkSession
from lakeloom.plans.registry import QUERIES
spark = SparkSession.builder.master("local-cluster[2,1,1024]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", "file://" + sys.argv[1]).getOrCreate()
print("ROWS", sorted(map(tuple, QUERIES["io_jdbc"](spark, sys.argv[2]).collect())))
spark.stop()
"""


def test_jdbc_on_a_cluster(tmp_path):
    """Executors are processes of their own here and share nothing with the driver but the folder."""
    own = Path(__file__).resolve().parent.parent
    done = subprocess.run([sys.executable, "-c", _ON_A_CLUSTER, str(tmp_path), SF], capture_output=True, text=True, timeout=300, cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(own)})
    con = duckdb.connect()
    con.execute(f"CREATE VIEW customer AS SELECT * FROM '{SF}/customer.parquet'")
    found = [x for x in done.stdout.splitlines() if x.startswith("ROWS")]
    assert found == [f"ROWS {sorted(con.sql(ORACLE_SQL['io_jdbc']).fetchall())}"], done.stderr[-3000:]
