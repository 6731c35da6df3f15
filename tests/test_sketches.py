"""Sketches kept as columns: what merging gives, how far from the truth, and what storing twice does."""

from pyspark.sql import functions as F

from lakeloom.operators import sketches as S


def rows(spark):
    return spark.range(60_000).select((F.col("id") % 30).cast("int").alias("day"), F.pmod(F.xxhash64("id"), F.lit(3)).alias("kind"), F.pmod(F.hash("id"), F.lit(20_000)).alias("user"), F.when(F.col("id") % 11 > 0, F.sqrt("id")).alias("x"))


def test_merged_sketches_are_near_at_every_level(spark):
    df = rows(spark)
    fine = S.sketched(df, ["day", "kind"], "user", "x").cache()
    for by in (["day", "kind"], ["day"], ["kind"], []):
        told = {tuple(r[c] for c in by): r for r in S.estimates(S.merged(fine, by), {"p10": 0.1, "p50": 0.5, "p99": 0.99}).collect()}
        true = {tuple(r[c] for c in by): r for r in df.groupBy(*by).agg(F.count("*").alias("n"), F.count_distinct("user").alias("users"), F.array_sort(F.collect_list("x")).alias("xs")).collect()}
        assert told.keys() == true.keys()
        for k, t in true.items():
            assert told[k].n == t.n
            assert abs(told[k].distinct - t.users) <= S.DISTINCT_ERROR * t.users
            for name, q in (("p10", 0.1), ("p50", 0.5), ("p99", 0.99)):
                rank = sum(x <= told[k][name] for x in t.xs) / len(t.xs)
                assert abs(rank - q) <= S.RANK_ERROR + 1 / len(t.xs)
    kinds = {r.kind: set(r.u) for r in df.groupBy("kind").agg(F.collect_set("user").alias("u")).collect()}
    for r in S.in_common(S.merged(fine, ["kind"]), "kind").collect():
        common, either = kinds[r.a] & kinds[r.b], kinds[r.a] | kinds[r.b]
        assert abs(r.common - len(common)) <= S.COMMON_ERROR * len(either)
    fine.unpersist()


def test_storing_a_day_twice_counts_it_once(spark, tmp_path):
    df, path = rows(spark), str(tmp_path / "s")
    schema = "kind long, n long, hll binary, theta binary, kll binary, day int"
    S.store(S.sketched(df.filter("day < 20"), ["day", "kind"], "user", "x"), path, "day")
    first = S.stored(spark, path, schema).select("day", "n").collect()
    for _ in range(2):
        S.store(S.sketched(df.filter("day >= 19"), ["day", "kind"], "user", "x"), path, "day")
    whole = S.merged(S.stored(spark, path, schema), [])
    assert whole.first().n == 60_000 and len(first) == 60
    exact = df.agg(F.count_distinct("user")).first()[0]
    assert abs(S.estimates(whole, {}).first().distinct - exact) <= S.DISTINCT_ERROR * exact


def test_nulls_and_empty_tables(spark):
    df = spark.createDataFrame([(1, None, None), (1, None, None), (2, 5, 1.5)], "g int, u long, x double")
    got = {r.g: r for r in S.estimates(S.sketched(df, ["g"], "u", "x"), {}).collect()}
    assert (got[1].n, got[1].distinct, got[2].distinct) == (2, 0, 1)
    assert S.merged(S.sketched(df.limit(0), ["g"], "u", "x"), ["g"]).count() == 0
