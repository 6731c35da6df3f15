"""Joins that Spark has no operator for, as compositions of those it has."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.operators.windows import in_ranges


def asof_join(left: DataFrame, right: DataFrame, *, on: str, by: list[str], right_cols: list[str], tolerance: Column | None = None, spread: bool = True) -> DataFrame:
    """For each row of left the last row of right with the same `by` and an `on` that isn't later, or nulls.

    Both sides become one table, sorted by key and time, and each left row takes the last right row before it. Among right
    rows at one time the largest in right_cols counts; a left row sees right rows of its own time. Null keys equal
    nothing, as in an equi-join. tolerance: the longest time back, as an interval or a number.

    With `spread`, rows go to range partitions of key and time, so a key of any size is cut where it needs to be, and the
    last right row of a key in earlier partitions, of which there is one a partition at most, is sent to all tasks.
    Without, one shuffle by key does, for keys that a task can hold.
    """
    value = F.struct(F.col(on).alias("__at"), *right_cols)
    rows = left.withColumn("__row", F.struct(*left.columns)).select(*by, on, F.lit(1).alias("__side"), "__row", F.lit(None).cast(_type(right.select(value.alias("v")))).alias("__right"))
    keyed = right.filter(F.col(on).isNotNull()).dropna(subset=by) if by else right.filter(F.col(on).isNotNull())
    other = keyed.select(*by, on, F.lit(0).alias("__side"), F.lit(None).cast(_type(rows.select("__row"))).alias("__row"), value.alias("__right"))
    order = [F.asc_nulls_first(on), F.asc("__side"), F.asc_nulls_first("__right")]
    both = rows.unionByName(other)
    if spread:
        both = in_ranges(both, [*(F.asc(c) for c in by), F.asc_nulls_first(on), F.asc("__side")], "asof")
        last = both.filter("__side = 0").groupBy("__part", *by).agg(F.max("__right").alias("__last"))
        # of each partition and key, also those that hold left rows only
        each = both.select("__part", *by).distinct().join(last, ["__part", *by], "left")
        earlier = F.last("__last", ignorenulls=True).over(Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
        carried = each.select("__part", *by, earlier.alias("__carried")).filter("__carried is not null")
        both = both.join(F.broadcast(carried), ["__part", *by], "left")
    before = Window.partitionBy(*(["__part"] if spread else []), *by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    found = F.last("__right", ignorenulls=True).over(before)
    # a left row without a time is before all right rows
    found = F.when(F.col(on).isNotNull(), F.coalesce(found, "__carried") if spread else found)
    seen = both.withColumn("__found", found).filter("__side = 1")
    fits = F.lit(True) if tolerance is None else F.col("__found.__at") >= F.col(on) - tolerance
    return seen.select("__row.*", *(F.when(fits, F.col(f"__found.{c}")).alias(c) for c in right_cols))


def _type(df: DataFrame) -> str:
    return df.schema[0].dataType.simpleString()


def range_join(points: DataFrame, ranges: DataFrame, *, point: str, low: str, high: str, width: float, by: list[str] | None = None, wide: int = 64) -> DataFrame:
    """Pairs with low <= point <= high, joined on bins instead of comparing all with all.

    Each range goes to every bin of its level that it touches, and a pair meets once, as a point has one bin a level.
    Bins of the first level have the given width; a range that would touch more than `wide` of them goes to a level whose
    bins are `wide` times as broad, and so on, so a range is repeated at most wide + 1 times, however long it is. Points
    look at the levels that occur. Choose a width near the usual length of a range.
    """
    by = by or []
    at = lambda c, size: F.floor(F.col(c).cast("double") / size).cast("long")
    whole = ranges.filter(F.col(low) <= F.col(high))
    length = (F.col(high).cast("double") - F.col(low).cast("double")) / width
    level = F.when(length <= wide, 0).otherwise(F.ceil(F.log(length) / F.log(F.lit(float(wide))) - 1e-12) - 1).cast("int")
    levels = sorted(r["l"] for r in whole.select(level.alias("l")).distinct().collect())
    size = lambda c: F.lit(float(width)) * F.pow(F.lit(float(wide)), c)
    binned = whole.withColumn("__level", level).withColumn("__bin", F.explode(F.sequence(at(low, size(F.col("__level"))), at(high, size(F.col("__level"))))))
    placed = points.withColumn("__level", F.explode(F.array(*(F.lit(k) for k in levels)) if levels else F.array().cast("array<int>")))
    found = placed.withColumn("__bin", at(point, size(F.col("__level")))).join(binned, ["__level", "__bin", *by])
    return found.filter(F.col(point).between(F.col(low), F.col(high))).drop("__bin", "__level")


def skewed_join(left: DataFrame, right: DataFrame, on: list[str], salts: int = 16, how: str = "inner") -> DataFrame:
    """An equi-join whose left side may hold hot keys: left rows are dealt over `salts` parts of their key and the right
    side is repeated that often. For when adaptive execution can't split the skew, as below an aggregate. Of joins only
    those that return no unmatched right rows: the copies of such a row would each count as unmatched."""
    if how not in ("inner", "left", "left_outer", "leftouter", "left_semi", "leftsemi", "semi", "left_anti", "leftanti", "anti"):
        raise ValueError(f"a salted join can't be {how}")
    spread = F.pmod(F.xxhash64(*left.columns), F.lit(salts)).cast("int")
    repeated = right.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.withColumn("__salt", spread).join(repeated, [*on, "__salt"], how).drop("__salt")
