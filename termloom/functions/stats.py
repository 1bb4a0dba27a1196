"""Normalisations and small statistics as window or array expressions.

Divisions that have no finite result give 0 throughout.
"""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def finite(x: Column) -> Column:
    """0 in place of null, NaN and infinities."""
    bad = F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    return F.coalesce(F.when(~bad, x), F.lit(0.0))


def ratio(a: Column, b: Column) -> Column:
    return finite(F.try_divide(a.cast("double"), b.cast("double")))


def by_sum(x: Column, *keys: str) -> Column:
    return ratio(x, F.sum(x).over(Window.partitionBy(*keys)))


def zscore(x: Column, *keys: str) -> Column:
    """Centred and scaled to unit length: the divisor is the root of the summed squares."""
    w = Window.partitionBy(*keys)
    return ratio(x - F.avg(x).over(w), F.sqrt(F.var_pop(x).over(w) * F.count(x).over(w)))


def linear(x: Column, *keys: str) -> Column:
    w = Window.partitionBy(*keys)
    low, high = F.min(x).over(w), F.max(x).over(w)
    return ratio(x - low, high - low)


NORMS = {"none": lambda x, *keys: finite(x), "sum": by_sum, "zscore": zscore, "linear": linear}


def by_absolute_sum(x: Column, *keys: str) -> Column:
    return ratio(x, F.sum(F.abs(x)).over(Window.partitionBy(*keys)))


def inverse(x: Column, *keys: str) -> Column:
    """Shares of 1/x."""
    return by_sum(F.try_divide(F.lit(1.0), x), *keys)


def square_sum(x: Column, *keys: str) -> Column:
    """x over the sum of squares (not its root)."""
    return ratio(x, F.sum(x * x).over(Window.partitionBy(*keys)))


def unit(x: Column, *keys: str) -> Column:
    return ratio(x, F.sqrt(F.sum(x * x).over(Window.partitionBy(*keys))))


def ranked(x: Column, *keys: str, tie: str) -> Column:
    """(n - rank) / n with rank 0 for the largest."""
    w = Window.partitionBy(*keys)
    rank = F.row_number().over(w.orderBy(x.desc(), F.col(tie))) - 1
    n = F.count(F.lit(1)).over(w)
    return ratio(n - rank, n)


def softmax(x: Column, *keys: str) -> Column:
    """Shifted by the largest, so large scores stay finite."""
    w = Window.partitionBy(*keys)
    e = F.exp(x - F.max(x).over(w))
    return ratio(e, F.sum(e).over(w))


def vote(weight: Column, *keys: str, order: str, seed: int = 12941) -> tuple[Column, Column]:
    """Cumulative share below and at each row, for picks by weight with a seeded uniform number."""
    w = Window.partitionBy(*keys)
    total = F.sum(weight).over(w)
    up = F.sum(weight).over(w.orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return ratio(up - weight, total), ratio(up, total)
