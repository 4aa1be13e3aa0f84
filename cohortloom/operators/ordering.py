"""Output order and first-n. Sorting the whole table is for output only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def total_order(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Sorted by unique keys: a range shuffle, so no key range has to sit in one task."""
    return df.orderBy(*keys)


def by_count_then_name(df: DataFrame, count: str, names: Sequence[str]) -> DataFrame:
    return df.orderBy(F.desc(count), *names)


def missing_last(df: DataFrame, level: str, missing: str = "Missing") -> DataFrame:
    return df.orderBy((F.col(level) == missing).cast("int"), level)


def first_n(df: DataFrame, order: Sequence[Column | str], n: int) -> DataFrame:
    """The first ``n`` rows; each task keeps ``n`` at most before they are merged."""
    return df.orderBy(*order).limit(n)
