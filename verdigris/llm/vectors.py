"""Whole-number vectors that the vector operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Components count as at most this in size: squares and products of 2**12 of them add up in 64 bits.
LARGEST = 2**24


def usable(vector: str) -> Column:
    """False or null for a vector that is null or has a null, NaN or infinite component."""
    return F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < F.lit(float("inf"))))


def integers(vector: str, scale: int) -> Column:
    """floor(scale * x) of each component, going down, between -LARGEST and LARGEST."""
    most = F.lit(float(LARGEST))
    return F.transform(vector, lambda x: F.floor(F.least(F.greatest(x.cast("double") * F.lit(float(scale)), -most), most)))


def padded(column: str, width: int) -> Column:
    """An array with zeros behind it, up to `width` elements."""
    return F.concat(column, F.array_repeat(F.lit(0).cast("long"), F.greatest(F.lit(width) - F.size(column), F.lit(0))))


def longest(rows: DataFrame, column: str) -> int:
    return rows.agg(F.max(F.size(column))).first()[0] or 0
