"""Ranges of a numeric key with about as many rows each, found from quantiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def quantiles(rows: DataFrame, key: str, parts: int) -> list[float]:
    """Bounds of so many parts: the least and the largest key, and what lies between."""
    some = rows.where(F.col(key).isNotNull())
    return sorted({float(q) for q in some.approxQuantile(key, [k / parts for k in range(parts + 1)], 0.25 / parts)})


def place_among(value: Column, bounds: list[float]) -> Column:
    """The number of the two neighbouring bounds that a value lies between, found by halves; the outer ones are open."""

    def search(first: int, last: int) -> Column:
        middle = (first + last) // 2
        return F.lit(first) if first + 1 >= last else F.when(value < F.lit(bounds[middle]), search(first, middle)).otherwise(search(middle, last))

    return search(0, len(bounds) - 1)
