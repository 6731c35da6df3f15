"""Reading and writing tables by format."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.sources.scratch import own_table, scratch

#: Formats that come with Spark. avro, jdbc and kafka need a package or driver on the class path.
FORMATS = ("parquet", "orc", "json", "csv", "text", "xml")


def read(spark: SparkSession, path: str, format: str = "parquet", schema: str | None = None, **options: str) -> DataFrame:
    """A table at a path. Give a schema for json, csv and xml: inferring one reads all data."""
    reader = spark.read.format(format).options(**options)
    return (reader.schema(schema) if schema else reader).load(path)


def write(df: DataFrame, path: str, format: str = "parquet", *, by: list[str] | None = None, mode: str = "errorifexists", **options: str) -> None:
    """Writes a table, partitioned by columns if asked. Rows are rebalanced by those columns: adaptive execution joins small
    values in one task, so there are few files, and splits a value that is too large for one."""
    if by:
        df = df.hint("rebalance", *(F.col(c) for c in by))
    writer = df.write.format(format).mode(mode).options(**options)
    (writer.partitionBy(*by) if by else writer).save(path)


def write_bucketed(df: DataFrame, by: list[str], buckets: int) -> DataFrame:
    """df as a table in the shared folder, in buckets by columns and sorted in them: joins and aggregates on these columns
    with tables of as many buckets need no shuffle, however often they run."""
    path = scratch(df.sparkSession, "bucketed")
    name = "bucketed_" + path.rpartition("-")[2]
    df.repartition(buckets, *by).write.bucketBy(buckets, *by).sortBy(*by).option("path", path).saveAsTable(own_table(df.sparkSession, name))
    return df.sparkSession.table(name)


def jdbc(spark: SparkSession, url: str, table: str, *, column: str, low: int, high: int, parts: int, **options: str) -> DataFrame:
    """A table over JDBC, read by ranges of a numeric column in parallel; needs the driver's jar."""
    return spark.read.jdbc(url, table, column=column, lowerBound=low, upperBound=high, numPartitions=parts, properties=options)
