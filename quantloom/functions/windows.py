"""Window frames of a panel, and gated rolling aggregates.

A panel is a DataFrame (instrument, ts, ...). All frames share one partitioning and one order, textually equal, so Spark
sorts once for any number of stacked windows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def by_instrument() -> WindowSpec:
    return Window.partitionBy("instrument")


def by_time() -> WindowSpec:
    return by_instrument().orderBy("ts")


def up_to_now() -> WindowSpec:
    """The frame of all rows up to the current one."""
    return by_time().rowsBetween(Window.unboundedPreceding, 0)


def up_to_before() -> WindowSpec:
    """The frame of all rows before the current one."""
    return by_time().rowsBetween(Window.unboundedPreceding, -1)



def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def last_rows(n: int):
    """The frame of the current row and the n - 1 before it."""
    return by_time().rowsBetween(1 - n, 0)


def next_rows(n: int):
    """The frame of the n rows after the current one."""
    return by_time().rowsBetween(1, n)


def rolling(agg: Callable[[Column], Column], x: Column | str, n: int) -> Column:
    """An aggregate over the last n rows, NULL until n values that are not NULL are in the frame."""
    x = col(x)
    return F.when(F.count(x).over(last_rows(n)) >= n, agg(x).over(last_rows(n)))


def lag(x: Column | str, k: int = 1) -> Column:
    return F.lag(col(x), k).over(by_time())


def row_number() -> Column:
    return F.row_number().over(by_time())


def compound(x: Column | str) -> Column:
    """Running product of 1 + x, NULL counting as 0; it stays at 0 from the first row with 1 + x <= 0."""
    growth = 1 + F.coalesce(col(x), F.lit(0.0))
    return F.when(F.min(growth).over(up_to_now()) <= 0, 0.0).otherwise(F.product(growth).over(up_to_now()))
