"""Access history: counts, recency, exponentially decayed weights; times come in, never from a clock."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def age_seconds(ts: Column, as_of: Column) -> Column:
    return F.unix_micros(as_of.cast("timestamp")) / 1e6 - F.unix_micros(ts.cast("timestamp")) / 1e6


def counts(accesses: DataFrame, key: str, ts: str = "ts") -> DataFrame:
    return accesses.groupBy(key).agg(F.count(F.lit(1)).alias("access_count"), F.max(ts).alias("last_access"))


def decayed(accesses: DataFrame, key: str, as_of: Column, decay: float, ts: str = "ts", horizon: float | None = None) -> DataFrame:
    """``key, weight``: the sum of exp(-decay age); with a horizon (5 / decay as a rule) older accesses are left out."""
    age = age_seconds(F.col(ts), as_of)
    rows = accesses.filter(age >= 0)
    if horizon is not None:
        rows = rows.filter(age < horizon)
    return rows.groupBy(key).agg(F.round(F.sum(F.exp(-decay * age)), 6).alias("weight"))
