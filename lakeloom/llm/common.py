"""What the operators of this subpackage share: shared scratch space, table reading, hashing.

Every operator takes a DataFrame, selects the columns it needs by name first (so extra columns, also ones whose
names clash with those it makes, never reach it) and returns a new DataFrame.
"""

from __future__ import annotations

import ctypes
import functools

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeloom.sources.scratch import materialise, release, shared_dir

__all__ = ["documents", "give_back", "id_bucket", "materialise", "partitions", "release", "shared_dir", "table"]


@functools.cache
def _trim():
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError):  # another C library than glibc
        return lambda pad: 0


def give_back() -> None:
    """Returns memory that was freed to the system. Python workers outlive tasks, so what each of them held at its peak
    would add up in an executor."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) with those names, whatever else df holds."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def id_bucket(col, modulus: int):
    """crc32 of the id's decimal text, modulo modulus: the split into training and held-out rows."""
    return F.crc32(col.cast("string").cast("binary")) % F.lit(modulus)
