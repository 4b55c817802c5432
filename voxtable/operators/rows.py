"""Array columns to rows.

The inner forms of explode and inline make the optimizer add a filter on the array, which
computes a costly array a second time and below any repartitioning. The outer forms with a
filter on the result give the same rows without that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def exploded(df: DataFrame, keep: list, array: Column | str, name: str) -> DataFrame:
    return df.select(*keep, F.explode_outer(array).alias(name)).where(F.col(name).isNotNull())


def numbered(df: DataFrame, keep: list, array: Column | str, number: str, name: str) -> DataFrame:
    return df.select(*keep, F.posexplode_outer(array).alias(number, name)).where(F.col(number).isNotNull())


def unpacked(df: DataFrame, keep: list, array: Column | str, marker: str) -> DataFrame:
    """Array of structs to columns; ``marker`` is a field that is never null."""
    return df.select(*keep, F.inline_outer(array)).where(F.col(marker).isNotNull())
