"""Changes to stored, partitioned tables: merge, update and delete that rewrite only the partitions they touch.

A table is a folder of Parquet files by partition. New contents of the touched partitions are written to the shared folder
first and then replace them partition by partition; the others' files are neither read in whole nor written. A run that broke
off is run again: each of these operations gives the same table twice over.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakeloom.sources.scratch import materialise

#: What a change's `op` says; any other value, null included, is an upsert.
DELETE = "delete"


def _replace(spark: SparkSession, path: str, partition: str, touched: DataFrame, content: DataFrame) -> None:
    """The touched partitions' contents become `content`, which holds no others; those left without rows go."""
    content = materialise(content, "content")
    touched = materialise(touched, "touched")
    written = content.select(partition).distinct()
    same = touched[partition].eqNullSafe(written[partition])
    # a partition is a folder: their number is bounded by what a folder listing holds
    emptied = [r[0] for r in touched.join(written, same, "left_anti").collect()]
    content.hint("rebalance", F.col(partition)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for value in emptied:
        name = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.getPartitionPathString(partition, None if value is None else str(value))
        files.delete(jvm.org.apache.hadoop.fs.Path(root, name), True)


def merge(spark: SparkSession, path: str, changes: DataFrame, keys: list[str], partition: str, *, op: str | None = None, order: str | None = None) -> None:
    """Brings the table at path up to changes: rows whose keys the table holds are replaced (and move to another partition,
    if the change says so), others are added; those whose column `op` is `delete` go. Of several changes of a key the one
    that is last by `order` counts. changes has the table's columns, beside op and order. Keys must not be null.

    Which partitions hold changed keys is found by their key columns alone; only those partitions are read in whole."""
    table = spark.read.parquet(path)
    if order:
        latest = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(order).desc_nulls_last()))
        changes = changes.withColumn("__n", latest).filter("__n = 1").drop("__n")
    changes = materialise(changes, "changes")
    held = table.select(*keys, partition).join(changes.select(*keys).distinct(), keys, "left_semi").select(partition)
    upserts = changes if op is None else changes.filter(F.coalesce(F.col(op), F.lit("")) != DELETE)
    upserts = upserts.select(*(F.col(c).cast(table.schema[c].dataType).alias(c) for c in table.columns))
    touched = materialise(held.unionByName(upserts.select(partition)).distinct(), "touched")
    kept = _within(table, touched, partition).join(changes.select(*keys), keys, "left_anti")
    _replace(spark, path, partition, touched, kept.select(*table.columns).unionByName(upserts))


def _within(table: DataFrame, touched: DataFrame, partition: str) -> DataFrame:
    """The table's rows in the touched partitions; the filter by a list prunes the scan."""
    values = [r[0] for r in touched.collect()]
    chosen = F.col(partition).isin([v for v in values if v is not None])
    return table.filter(chosen | F.col(partition).isNull() if None in values else chosen)


def update(spark: SparkSession, path: str, condition: Column, changes: dict[str, Column], partition: str) -> None:
    """Sets columns of the rows that meet the condition; the partition column may be among them."""
    table = spark.read.parquet(path)
    where = F.coalesce(condition, F.lit(False))
    before = table.filter(where)
    after = before.select(*(changes[c].cast(table.schema[c].dataType).alias(c) if c in changes else F.col(c) for c in table.columns))
    touched = materialise(before.select(partition).unionByName(after.select(partition)).distinct(), "touched")
    kept = _within(table, touched, partition).filter(~where)
    _replace(spark, path, partition, touched, kept.unionByName(after))


def delete(spark: SparkSession, path: str, condition: Column, partition: str) -> None:
    """Removes the rows that meet the condition."""
    table = spark.read.parquet(path)
    where = F.coalesce(condition, F.lit(False))
    touched = materialise(table.filter(where).select(partition).distinct(), "touched")
    _replace(spark, path, partition, touched, _within(table, touched, partition).filter(~where))
