"""Tables with statistics, joins in the order that costs least by them, and tables of another engine over JDBC."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from lakeloom.sources.scratch import own_table, scratch


def analysed(df: DataFrame, columns: list[str]) -> str:
    """Writes df as a table of the catalogue, in the shared folder, with statistics of its size and of these columns
    (distinct values, ranges, nulls); returns its name. release() drops it."""
    spark, path = df.sparkSession, scratch(df.sparkSession, "analysed")
    name = "analysed_" + path.rpartition("-")[2]
    df.write.option("path", path).saveAsTable(own_table(spark, name))
    spark.sql(f"ANALYZE TABLE {name} COMPUTE STATISTICS FOR COLUMNS {', '.join(columns)}")
    return name


def cost_based(spark: SparkSession) -> SparkSession:
    """A session beside this one that orders joins by cost, from the statistics of tables; the catalogue is shared."""
    session = spark.newSession()
    for name in ("enabled", "joinReorder.enabled", "joinReorder.dp.star.filter", "planStats.enabled"):
        session.conf.set(f"spark.sql.cbo.{name}", "false" if name.endswith("filter") else "true")
    return session


def jdbc_catalog(spark: SparkSession, url: str, driver: str) -> str:
    """The name of a new catalogue of a database's tables, which takes over filters, aggregates, limits and orders."""
    name = "jdbc_" + uuid.uuid4().hex
    for key, value in (("", "org.apache.spark.sql.execution.datasources.v2.jdbc.JDBCTableCatalog"), (".url", url), (".driver", driver), (".pushDownAggregate", "true"), (".pushDownLimit", "true")):
        spark.conf.set(f"spark.sql.catalog.{name}{key}", value)
    return name
