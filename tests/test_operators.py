"""Operators on small tables with nulls, ties and no rows."""

import pytest
from pyspark.sql import functions as F

from lakeloom.operators.joins import asof_join, range_join, skewed_join
from lakeloom.operators.windows import exact_quantiles, numbered
from lakeloom.sources import scratch, tables
from lakeloom.streaming import events as ev


@pytest.mark.parametrize("spread", [True, False])
def test_asof_nulls_ties_tolerance(spark, spread):
    left = spark.createDataFrame([("a", 5, 1), ("a", 1, 2), ("b", 9, 3), ("a", None, 4), ("a", 10, 5)], "k string, t int, id int")
    right = spark.createDataFrame([("a", 2, 7.0), ("a", 5, 8.0), ("a", 5, 9.0), ("b", 10, 1.0), ("a", None, 3.0)], "k string, t int, v double")
    got = {r.id: r.v for r in asof_join(left, right, on="t", by=["k"], right_cols=["v"], spread=spread).collect()}
    assert got == {1: 9.0, 2: None, 3: None, 4: None, 5: 9.0}
    near = {r.id: r.v for r in asof_join(left, right, on="t", by=["k"], right_cols=["v"], tolerance=F.lit(2), spread=spread).collect()}
    assert near[1] == 9.0 and near[5] is None
    assert asof_join(left.limit(0), right, on="t", by=["k"], right_cols=["v"], spread=spread).count() == 0


def test_asof_null_keys_equal_nothing(spark):
    left = spark.createDataFrame([(None, 5, 1), ("a", 5, 2)], "k string, t int, id int")
    right = spark.createDataFrame([(None, 2, 7.0), ("a", 2, 8.0)], "k string, t int, v double")
    for spread in (True, False):
        assert {r.id: r.v for r in asof_join(left, right, on="t", by=["k"], right_cols=["v"], spread=spread).collect()} == {1: None, 2: 8.0}


def test_asof_of_a_hot_key(spark):
    """A key over all range partitions: its last right row is carried into partitions that hold none before a left row."""
    left = spark.range(3000).select(F.when(F.col("id") % 10 < 9, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 70)).alias("k"), F.col("id").alias("t"), "id")
    right = spark.range(0, 3000, 97).select(F.when(F.col("id") % 2 == 0, "hot").otherwise("k9").alias("k"), F.col("id").alias("t"), F.col("id").alias("v")).filter("t < 900 or k <> 'hot'")
    one, two = (sorted(map(tuple, asof_join(left, right, on="t", by=["k"], right_cols=["v"], spread=x).select("id", "v").collect())) for x in (True, False))
    assert one == two and sum(v == 776 for _, v in one) > 1000


def test_places_and_quantiles_of_groups(spark):
    rows = [(None if i % 7 == 0 else "a" if i % 5 else "b", float(i * 37 % 501) if i % 11 else None, i) for i in range(2000)] + [("c", None, 5000), ("d", 4.0, 5001)]
    df = spark.createDataFrame(rows, "k string, v double, id int").repartition(6)
    got = {(r.k, r.id): r.place for r in numbered(df, [F.asc_nulls_last("v"), F.asc("id")], "place", ["k"]).collect()}
    for k in (None, "a", "b", "c", "d"):
        own = sorted((v is None, v or 0, i) for key, v, i in rows if key == k)
        assert [got[k, i] for *_, i in own] == list(range(1, len(own) + 1))
    import numpy as np

    shares = {"low": 0.0, "q": 0.31, "mid": 0.5, "p90": 0.9, "high": 1.0}
    found = {r.k: r for r in exact_quantiles(df, ["k"], "v", shares).collect()}
    assert set(found) == {None, "a", "b", "d"}
    for k, r in found.items():
        own = [v for key, v, _ in rows if key == k and v is not None]
        assert np.allclose([r[n] for n in shares], np.quantile(own, list(shares.values())))
    assert exact_quantiles(df.limit(0), ["k"], "v", shares).count() == 0


def test_write_splits_a_hot_value(spark, tmp_path):
    keys = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "100k"}
    before = {k: spark.conf.get(k) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        df = spark.range(400_000).select("id", F.when(F.col("id") % 10 > 0, 0).otherwise(F.col("id") % 5 + 1).alias("k"))
        tables.write(df, f"{tmp_path}/t", by=["k"])
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(list((tmp_path / "t" / "k=0").glob("*.parquet"))) > 1
    assert tables.read(spark, f"{tmp_path}/t").count() == 400_000


def test_buckets_join_without_a_shuffle(spark):
    a = tables.write_bucketed(spark.range(1000).select("id", (F.col("id") % 7).alias("x")), ["id"], 4)
    b = tables.write_bucketed(spark.range(0, 2000, 2).select("id", F.lit(1).alias("y")), ["id"], 4)
    joined = a.hint("merge").join(b, "id").groupBy("id").agg(F.sum("y").alias("n"))
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "SortMergeJoin" in plan and joined.count() == 500


def test_jdbc_reads_ranges(spark):
    """Against the Derby that comes with Spark, in this process' memory."""
    url, options = "jdbc:derby:memory:lakeloom;create=true", {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    spark.range(1000).select(F.col("id").alias("N"), (F.col("id") * 3).alias("V")).write.jdbc(url, "T", mode="overwrite", properties=options)
    found = tables.jdbc(spark, url, "T", column="N", low=0, high=1000, parts=4, **options)
    assert found.rdd.getNumPartitions() == 4
    assert sorted(map(tuple, found.collect())) == [(i, 3 * i) for i in range(1000)]
    assert found.filter("N > 990").count() == 9


def test_no_local_folder_off_one_process(monkeypatch):
    """On a cluster an unset checkpoint folder is an error, not a folder that other machines don't see."""

    class Conf:
        def get(self, *_):
            return None

    class Session:
        conf = Conf()

        class sparkContext:
            master, applicationId = "spark://host:7077", "app"
            getConf = staticmethod(Conf)

    with pytest.raises(RuntimeError):
        scratch.shared_dir(Session())


def test_wide_ranges_repeat_little(spark):
    points = spark.createDataFrame([(i, float(i * 997 % 100_003)) for i in range(300)], "id int, x double")
    ranges = spark.createDataFrame([(i, float(i * 1009 % 90_000), float(i * 1009 % 90_000) + 7.0**i) for i in range(7)] + [(9, -1e7, 1e7), (10, 5.0, 5.0)], "r int, lo double, hi double")
    found = range_join(points, ranges, point="x", low="lo", high="hi", width=1.0)
    want = sorted(map(tuple, points.join(ranges, F.expr("x between lo and hi")).select("id", "r").collect()))
    assert sorted(map(tuple, found.select("id", "r").collect())) == want and want


def test_range_join_equals_comparing_all(spark):
    points = spark.createDataFrame([(i, float(i * 7 % 101) - 20) for i in range(200)] + [(999, None)], "id int, x double")
    ranges = spark.createDataFrame([(i, float(i * 13 % 97) - 30, float(i * 13 % 97) - 30 + i % 9) for i in range(50)] + [(77, 5.0, 1.0)], "r int, lo double, hi double")
    got = sorted(map(tuple, range_join(points, ranges, point="x", low="lo", high="hi", width=4.0).select("id", "r").collect()))
    want = sorted(map(tuple, points.join(ranges, F.expr("x between lo and hi")).select("id", "r").collect()))
    assert got == want and got


@pytest.mark.parametrize("how", ["inner", "left"])
def test_skewed_join(spark, how):
    left = spark.createDataFrame([(1 if i % 3 else i, i) for i in range(300)], "k int, v int")
    right = spark.createDataFrame([(1, "x"), (3, "y"), (1, "z")], "k int, w string")
    assert sorted(map(tuple, skewed_join(left, right, ["k"], 5, how).collect()), key=repr) == sorted(map(tuple, left.join(right, "k", how).collect()), key=repr)


@pytest.mark.parametrize("how", ["right", "full", "outer"])
def test_skewed_join_refuses(spark, how):
    with pytest.raises(ValueError):
        skewed_join(spark.range(3), spark.range(3), ["id"], 4, how)


def test_late_rows_are_dropped(spark, tmp_path):
    """An hour's rows that come after the watermark has passed them twice over don't count."""
    times = [("2024-01-01 00:10:00", 1), ("2024-01-01 05:10:00", 2), ("2024-01-01 06:10:00", 3), ("2024-01-01 00:20:00", 4), ("2024-01-01 12:00:00", 5)]
    for k, (t, i) in enumerate(times):
        spark.createDataFrame([(t, i, 1.0)], "t string, id long, value double").select(F.to_timestamp("t").alias("ts"), "id", "value").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in{k}")
        import shutil
        import time
        from pathlib import Path

        Path(f"{tmp_path}/in").mkdir(exist_ok=True)
        for p in Path(f"{tmp_path}/in{k}").glob("part-*"):
            shutil.copy(p, f"{tmp_path}/in/{k}-{p.name}")
        time.sleep(0.02)
    rows = ev.tumbling(ev.stream(spark, f"{tmp_path}/in", "ts timestamp, id long, value double", delay="1 hour"), "1 hour")
    got = {}
    ev.run_once(rows, f"{tmp_path}/state", "append", lambda df, k: got.update({str(r.start): r.n for r in df.collect()}))
    assert got.get("2024-01-01 00:00:00") == 1
    assert "2024-01-01 12:00:00" not in got
