"""Sampling by a hash, which gives the same rows on any partitioning and in any engine with md5."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bernoulli(df: DataFrame, share: float, key: list[str | Column], seed: int = 0) -> DataFrame:
    """About `share` of the rows; a row's fate hangs on its key and the seed alone: the first 28 bits of the md5 of seed
    and key as text, joined by colons (nulls count as empty)."""
    text = F.concat_ws(":", F.lit(str(seed)), *(F.coalesce((F.col(k) if isinstance(k, str) else k).cast("string"), F.lit("")) for k in key))
    return df.filter(F.conv(F.substring(F.md5(text), 1, 7), 16, 10).cast("long") < share * (1 << 28))
