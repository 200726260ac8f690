"""Quantiles by the exclusive method."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def exclusive_quantile(ordered: Column, i: int, n: int) -> Column:
    """The i-th of the n - 1 cuts of a sorted array; a single value is its own cut, an empty array has none."""
    size = F.size(ordered)
    at = F.greatest(F.lit(1), F.least(F.floor(i * (size + 1) / n).cast("int"), size - 1))
    delta = i * (size + 1) - at * n
    between = (F.element_at(ordered, at) * (n - delta) + F.element_at(ordered, at + 1) * delta) / n
    return F.when(size > 1, between).when(size == 1, F.get(ordered, F.lit(0)))
