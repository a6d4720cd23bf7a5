"""Ordered page lists as arrays."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def toggled(a: Column, x: Column) -> Column:
    return F.when(F.array_contains(a, x), F.array_remove(a, x)).otherwise(F.array_append(a, x))


def removed_at(a: Column, k: Column) -> Column:
    """Without the element at k (from 0); unchanged if k is out of range."""
    return F.filter(a, lambda _, i: i != k)


def reordered(a: Column, order: Column) -> Column:
    """By a permutation of 0..n-1; null for any other order."""
    n = F.size(a)
    want = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.when(F.array_sort(order) == want, F.transform(order, lambda i: F.get(a, i)))


def moved(a: Column, source: Column, target: Column) -> Column:
    rest = removed_at(a, source)
    return F.concat(F.slice(rest, F.lit(1), target), F.array(F.get(a, source)), F.slice(rest, target + 1, F.size(a)))
