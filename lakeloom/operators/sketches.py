"""Sketches as columns: kept by partition, added to day by day, merged to any coarser level without the rows.

Three kinds: HyperLogLog for numbers of distinct values, KLL for ranks and quantiles, theta for distinct values that sets
have in common. Each is a binary column of bounded size, whatever it has seen.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of HyperLogLog's and theta's addresses, KLL's size.
LG_K, THETA_LG_K, KLL_K = 12, 12, 400
#: Bounds that hold with near certainty: four standard errors, 1.04 / sqrt(2**LG_K) of HyperLogLog and 1 / sqrt(2**THETA_LG_K)
#: of theta (of the union), and KLL's normalised rank error, some 0.7 % at this size for 99 % of single ranks, doubled.
DISTINCT_ERROR, COMMON_ERROR, RANK_ERROR = 4 * 1.04 / 2 ** (LG_K / 2), 4 / 2 ** (THETA_LG_K / 2), 0.014


def sketched(df: DataFrame, by: list[str], distinct: str, measure: str) -> DataFrame:
    """A row for each group of `by`: its rows, and sketches of the values of `distinct` (hll, theta) and `measure` (kll).
    Nulls are in no sketch. Tasks sketch their own rows first, so a hot group is shuffled as one sketch a task."""
    return df.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.hll_sketch_agg(distinct, F.lit(LG_K)).alias("hll"),
        F.theta_sketch_agg(distinct, F.lit(THETA_LG_K)).alias("theta"),
        F.kll_sketch_agg_double(F.col(measure).cast("double"), F.lit(KLL_K)).alias("kll"),
    )


def merged(sketches: DataFrame, by: list[str]) -> DataFrame:
    """Sketches of a coarser level, from those of a finer one: by is any part of its keys, or nothing for one row."""
    return sketches.groupBy(*by).agg(F.sum("n").alias("n"), F.hll_union_agg("hll", F.lit(False)).alias("hll"), F.theta_union_agg("theta", F.lit(THETA_LG_K)).alias("theta"), F.kll_merge_agg_double("kll", F.lit(KLL_K)).alias("kll"))


def store(sketches: DataFrame, path: str, partition: str) -> None:
    """Adds sketches to a stored table, partition by partition: those that come anew are replaced, so a day that is run
    twice counts once; others are neither read nor written."""
    sketches.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)


def stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def estimates(sketches: DataFrame, shares: dict[str, float]) -> DataFrame:
    """The sketches' columns replaced by the estimated number of distinct values and a column for each quantile."""
    quantiles = [F.kll_sketch_get_quantile_double("kll", F.lit(q)).alias(name) for name, q in shares.items()]
    kept = [c for c in sketches.columns if c not in ("hll", "theta", "kll")]
    return sketches.select(*kept, F.hll_sketch_estimate("hll").alias("distinct"), *quantiles)


def in_common(sketches: DataFrame, by: str) -> DataFrame:
    """(a, b, common, either) for each two groups a < b of `by`, of which there are few: estimates of how many values both
    have, and either."""
    a, b = sketches.select(F.col(by).alias("a"), F.col("theta").alias("ta")), sketches.select(F.col(by).alias("b"), F.col("theta").alias("tb"))
    both = a.join(b, F.col("a") < F.col("b"))
    return both.select("a", "b", F.theta_sketch_estimate(F.theta_intersection("ta", "tb")).alias("common"), F.theta_sketch_estimate(F.theta_union("ta", "tb")).alias("either"))
