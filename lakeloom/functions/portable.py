"""Functions whose results other SQL engines share, where Spark's own differ from them in detail."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def upper(text: Column) -> Column:
    """Upper case that keeps the length: sharp s becomes SS either way, but only as two letters here."""
    return F.upper(F.replace(text, F.lit("ß"), F.lit("ss")))


def ln(x: Column) -> Column:
    """Natural logarithm to nine places; the last bits differ between libraries."""
    return F.round(F.ln(x), 9)


def truncate(x: Column) -> Column:
    """A double's whole part as a long, towards zero."""
    return x.cast("long")


def day_of_week(day: Column) -> Column:
    """From 0, Sunday, to 6."""
    return (F.dayofweek(day) - 1).cast("long")


def sum_of(x: Column, places: int = 2) -> Column:
    """A sum of doubles to so many places. Its last bits hang on the order of the rows; rounding hides that unless the sum
    stands within them of a half."""
    return F.round(F.sum(x), places)
