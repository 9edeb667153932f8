"""Masks, hashes and geometry as columns."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def display(value: Column) -> Column:
    """All but the first and last character hidden; values of up to two characters wholly."""
    n = F.length(value)
    return F.when(n <= 2, F.rpad(F.lit(""), n, "•")).otherwise(F.concat(F.substring(value, 1, 1), F.rpad(F.lit(""), n - 2, "•"), F.right(value, F.lit(1))))


def value_hash(value: Column, salt: str) -> Column:
    return F.sha2(F.concat(F.lit(salt), F.lit(":"), value), 256)


def iou(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Intersection over union of two intervals."""
    inter = F.greatest(F.lit(0), F.least(a1, b1) - F.greatest(a0, b0))
    return inter / ((a1 - a0) + (b1 - b0) - inter)


def normalised(x: Column, size: Column) -> Column:
    return F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), x / size)), 6)
