"""Window frames, top-n by group, and places and quantiles of groups that no task could hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.sources.scratch import materialise


def top_n(df: DataFrame, n: int, by: list[str], order: list[Column]) -> DataFrame:
    """The first n rows of each group. Spark limits groups before the shuffle as well (WindowGroupLimit)."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("__rank", rank).filter(F.col("__rank") <= n).drop("__rank")


def unbounded(by: list[str], order: list[Column | str]):
    """The window whose frame is the whole group, for first, last and nth values."""
    return Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def in_ranges(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df in range partitions, written, with the number of a row's partition as __part: no row of a partition comes before
    one of the partitions before it, and a group of any size is spread over as many as it needs."""
    return materialise(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()), name)


def numbered(df: DataFrame, order: list[Column], name: str, by: list[str] | None = None) -> DataFrame:
    """All rows with their place, from 1 on, in the table or in their group of `by`; the order must be total. Rows are
    numbered in range partitions, to which the rows of the partitions before are added, so no task sees a whole group."""
    by = by or []
    parts = in_ranges(df, [*(F.asc(c) for c in by), *order], "numbered")
    # a row for each partition and group in it
    before = F.sum("__n").over(Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = parts.groupBy("__part", *by).agg(F.count("*").alias("__n")).select("__part", *by, before.alias("__before"))
    place = F.row_number().over(Window.partitionBy("__part", *by).orderBy(*order)) + F.coalesce("__before", F.lit(0))
    # only groups that began in an earlier partition, at most one a partition, have rows before
    offsets = offsets.filter("__before > 0").select(F.col("__part").alias("__p"), *(F.col(c).alias(f"__by{k}") for k, c in enumerate(by)), "__before")
    same = F.col("__part") == F.col("__p")
    for k, c in enumerate(by):
        same &= F.col(c).eqNullSafe(F.col(f"__by{k}"))
    return parts.join(F.broadcast(offsets), same, "left").select(*df.columns, place.cast("long").alias(name))


def exact_quantiles(df: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """A row for each group of `by`: of its values that aren't null the quantile for each share, between neighbours by
    linear interpolation. No task holds a group's values, also where they are all the same; groups without any value have
    no row."""
    # rows with equal values are told apart by where they are read, so that ranges can cut between them
    tie = F.xxhash64(F.monotonically_increasing_id()).alias("__tie")
    rows = df.filter(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("__v"), tie)
    sizes = rows.groupBy(*by).agg(F.count("*").alias("__size")).select(*(F.col(c).alias(f"__k{i}") for i, c in enumerate(by)), "__size")
    same = F.lit(True)
    for i, c in enumerate(by):
        same &= F.col(c).eqNullSafe(F.col(f"__k{i}"))
    placed = numbered(rows, [F.asc("__v"), F.asc("__tie")], "__place", by).join(sizes, same)
    low = {n: F.floor((F.col("__size") - 1) * q) + 1 for n, q in shares.items()}
    asked = F.lit(False)
    for at in low.values():
        asked |= F.col("__place").between(at, at + 1)
    out = []
    for n, q in shares.items():
        part = (F.col("__size") - 1) * q - F.floor((F.col("__size") - 1) * q)
        a = F.max(F.when(F.col("__place") == low[n], F.col("__v")))
        b = F.max(F.when(F.col("__place") == low[n] + 1, F.col("__v")))
        out.append((a + F.max(part) * (F.coalesce(b, a) - a)).alias(n))
    return placed.filter(asked).groupBy(*by).agg(*out)
