"""Result caching: an in-process cache of DataFrames, and its rules as a query over a log of puts."""

from __future__ import annotations

import time
from collections import OrderedDict
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TTL_SECONDS, CAPACITY = 300.0, 10_000


class ResultCache:
    """Results by (query, k, version of the index); the oldest put goes first, and entries end after ``ttl`` seconds."""

    def __init__(self, capacity: int = CAPACITY, ttl: float = TTL_SECONDS, clock: Callable[[], float] = time.time):
        self.capacity, self.ttl, self.clock = capacity, ttl, clock
        self.entries: OrderedDict[tuple, tuple[DataFrame, float]] = OrderedDict()

    def get(self, query: str, k: int, version: int = 0) -> DataFrame | None:
        key = (query.lower(), k, version)
        if key in self.entries:
            df, put = self.entries[key]
            if self.clock() - put <= self.ttl:
                return df
            self._drop(key)
        return None

    def put(self, query: str, k: int, df: DataFrame, version: int = 0) -> DataFrame:
        key = (query.lower(), k, version)
        if key in self.entries:
            self._drop(key)
        while len(self.entries) >= self.capacity:
            self._drop(next(iter(self.entries)))
        self.entries[key] = (df.cache(), self.clock())
        return self.entries[key][0]

    def _drop(self, key: tuple) -> None:
        self.entries.pop(key)[0].unpersist()


def live_entries(puts: DataFrame, as_of: Column, capacity: int = CAPACITY, ttl: float = TTL_SECONDS) -> DataFrame:
    """``query, put_ts`` of what a log of puts leaves in the cache: each query's last put, not older than ``ttl``, of which the newest ``capacity``."""
    last = puts.groupBy("query").agg(F.max("put_ts").alias("put_ts"))
    age = F.unix_micros(as_of.cast("timestamp")) / 1e6 - F.unix_micros(F.col("put_ts").cast("timestamp")) / 1e6
    return last.filter((age <= ttl) & (age >= 0)).orderBy(F.desc("put_ts"), "query").limit(capacity)


def eviction_order(puts: DataFrame) -> DataFrame:
    """``query, put_ts, rn``: 1 is the newest. Ranks are counted per day first, so that no task orders the whole log."""
    rows = puts.withColumn("day", F.to_date("put_ts"))
    per_day = rows.groupBy("day").agg(F.count(F.lit(1)).alias("c"))
    before = per_day.withColumn("newer", F.sum("c").over(Window.orderBy(F.desc("day"))) - F.col("c")).select("day", "newer")
    w = Window.partitionBy("day").orderBy(F.desc("put_ts"), "query")
    return rows.withColumn("k", F.row_number().over(w)).join(before, "day").select("query", "put_ts", (F.col("k") + F.col("newer")).alias("rn"))
