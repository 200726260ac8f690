"""Benchmarks of searches: one query at a time, in batches over a thread pool, and against a baseline.

A search is any callable from a query text to a DataFrame. Times are wall-clock times of collecting its result; summaries are Spark
aggregations over the timings.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import metrics

Search = Callable[[str], DataFrame]

_TIMINGS = "name string, batch int, query string, iteration int, seconds double, rows bigint"


def run(spark: SparkSession, search: Search, queries: list[str], iterations: int = 1, threads: int = 1, batch: int | None = None, name: str = "engine") -> DataFrame:
    """``name, batch, query, iteration, seconds, rows`` of each run; ``threads`` queries of a batch run at once. An empty list of queries gives an empty table."""

    def once(job: tuple[int, str, int]) -> tuple:
        began = time.perf_counter()
        rows = len(search(job[1]).collect())
        return (name, job[0], job[1], job[2], time.perf_counter() - began, rows)

    size = batch or max(1, len(queries))
    done: list[tuple] = []
    with ThreadPoolExecutor(threads) as pool:
        for first in range(0, len(queries), size):
            done += pool.map(once, [(first // size, q, i) for i in range(iterations) for q in queries[first : first + size]])
    return spark.createDataFrame(done, _TIMINGS)


def report(timings: DataFrame) -> DataFrame:
    """``name, min_time, max_time, avg_time, runs, qps, p95, p99`` of each search."""
    cuts = metrics.quantiles(timings, "seconds", ["name"]).select("name", "p95", "p99")
    return metrics.summary(timings, "seconds", ["name"]).join(cuts, "name")


def compare(spark: SparkSession, engine: Search, baseline: Search, queries: list[str], iterations: int = 1) -> DataFrame:
    """``query, time_ratio, qps_ratio`` of two searches over the same queries: above 1 in time, the engine is faster."""
    e, b = (metrics.summary(run(spark, s, queries, iterations), "seconds", ["query"]) for s in (engine, baseline))
    return metrics.improvement(e, b, "query")


def batches(timings: DataFrame) -> DataFrame:
    """``batch, runs, avg_time, qps`` of each batch."""
    return metrics.summary(timings, "seconds", ["batch"]).select("batch", "runs", "avg_time", F.col("qps"))
