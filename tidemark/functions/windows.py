"""Windows of the panel: W runs over a symbol's dates, D stands across the symbols of a date."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def over_time(*keys: str) -> WindowSpec:
    return Window.partitionBy(*(keys or ("symbol",))).orderBy("Date")


def across(*keys: str) -> WindowSpec:
    return Window.partitionBy(*(keys or ("Date",)))


def last_rows(n: int, *keys: str) -> WindowSpec:
    return over_time(*keys).rowsBetween(-(n - 1), 0)


def full(agg: Column, value: Column, n: int, *keys: str, least: int | None = None) -> Column:
    """agg over the last n rows, null until `least` (all n unless given) values are there."""
    w = last_rows(n, *keys)
    return F.when(F.count(value).over(w) >= (least or n), agg.over(w))


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return a / F.nullif(b, F.lit(0.0))


def average_rank(value: str, *keys: str) -> Column:
    """Ranks of the non-null values from 1, ties at their mean; null for null."""
    order = Window.partitionBy(*keys).orderBy(F.col(value).asc_nulls_last())
    ties = Window.partitionBy(*keys, value)
    return F.when(F.col(value).isNotNull(), F.rank().over(order) + (F.count(F.lit(1)).over(ties) - 1) / 2)


def percentile(value: Column, share: float) -> Column:
    return F.percentile(value, F.lit(share))
