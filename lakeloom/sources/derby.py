"""Tables in Derby, the database that comes with Spark, which a cluster can write and read.

Derby is embedded, and a database that is written belongs to one process. But one in a JAR file is read-only, and any number
of processes may open it. So each task loads its rows into a database of its own and puts that into the shared folder; any
executor, and the driver for the schema, then opens it there over JDBC.
"""

from __future__ import annotations

import glob
import os
import re
import subprocess
import tempfile
import uuid
import zipfile
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.csv
import pyspark
from pyspark.sql import DataFrame

from lakeloom.sources.catalog import jdbc_catalog
from lakeloom.sources.scratch import scratch

DRIVER = "org.apache.derby.jdbc.EmbeddedDriver"
#: Rows of a database, about, and the most databases, beyond which they hold more rows.
ROWS = 100_000
DATABASES = 64
_TYPES = {"string": "VARCHAR(32672)", "boolean": "BOOLEAN", "smallint": "SMALLINT", "int": "INTEGER", "bigint": "BIGINT", "float": "REAL", "double": "DOUBLE", "date": "DATE"}


def databases(df: DataFrame, table: str, *, rows: int = ROWS) -> list[DataFrame]:
    """df's rows as a table in several databases, about `rows` in each: a DataFrame of each, which takes over filters and
    aggregates. Aggregate each of them and then their results. No rows make no database. Needs a shared folder that is mounted as a path, and Java
    where executors run, as Spark does. Double quotes in a column's name aren't supported, nor are NaN and infinity."""
    spark, path = df.sparkSession, re.sub("^file:/+", "/", scratch(df.sparkSession, "derby"))
    if not path.startswith("/"):
        raise RuntimeError(f"Derby opens files only, and {path} is none")
    columns = ", ".join(f'"{f.name}" {_TYPES.get(f.dataType.simpleString(), f.dataType.simpleString())}' for f in df.schema)

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with tempfile.TemporaryDirectory() as folder:
            folder = os.path.realpath(folder)  # as another process, too, sees it
            with open(f"{folder}/rows.csv", "wb") as f:
                for batch in batches:
                    pa.csv.write_csv(batch, f, pa.csv.WriteOptions(include_header=False))
            _ij(folder, f'CREATE TABLE APP."{table}" ({columns})', f"CALL SYSCS_UTIL.SYSCS_IMPORT_TABLE('APP', '{table}', '{folder}/rows.csv', NULL, NULL, 'UTF-8', 0)")
            os.makedirs(path, exist_ok=True)
            made = f"{path}/{uuid.uuid4().hex}.jar"
            with zipfile.ZipFile(made, "w", zipfile.ZIP_STORED) as jar:  # stored, so that Derby can seek in it
                for file in glob.glob(f"{folder}/db/**", recursive=True):
                    jar.write(file, os.path.relpath(file, folder))
        yield pa.RecordBatch.from_pydict({"jar": [made]})

    parts = min(DATABASES, -(-df.count() // rows))
    if not parts:
        return [df.limit(0)]
    made = [r["jar"] for r in df.repartition(parts).mapInArrow(load, "jar string").collect()]
    return [spark.table(f'{jdbc_catalog(spark, f"jdbc:derby:jar:({jar})db", DRIVER)}.APP.`{table}`') for jar in made]


def _ij(folder: str, *statements: str) -> None:
    """Runs statements in the new database folder/db by Derby's own tool and shuts it down."""
    java = os.path.join(os.environ["JAVA_HOME"], "bin", "java") if os.environ.get("JAVA_HOME") else "java"
    jars = os.path.join(os.environ.get("SPARK_HOME") or os.path.dirname(pyspark.__file__), "jars")
    script = ["CONNECT 'jdbc:derby:db;create=true'", *statements, "DISCONNECT", "CONNECT 'jdbc:derby:db;shutdown=true'", "EXIT"]
    options = ["-Xmx128m", "-XX:+UseSerialGC", f"-Dderby.system.home={folder}", "-Dderby.storage.pageSize=8192"]
    done = subprocess.run([java, *options, "-cp", ":".join(glob.glob(f"{jars}/derby*.jar")), "org.apache.derby.tools.ij"], input=";\n".join(script) + ";\n", capture_output=True, text=True, cwd=folder)
    failed = [x for x in done.stdout.splitlines() if x.startswith(("ERROR", "IJ ERROR")) and not x.startswith("ERROR 08006")]  # the shutdown
    if failed or done.returncode or "ERROR 08006" not in done.stdout:
        raise RuntimeError(f"Derby: {' '.join(failed) or done.stdout[-2000:] + done.stderr[-2000:]}")
