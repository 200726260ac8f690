"""Latency and cache metrics over batches; the same functions serve the streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def summary(rows: DataFrame, latency: str, by: list[str] | None = None) -> DataFrame:
    """Least, greatest and mean latency, runs, and runs per second of latency."""
    x = F.col(latency)
    return rows.groupBy(*(by or [])).agg(
        F.round(F.min(x), 6).alias("min_time"), F.round(F.max(x), 6).alias("max_time"), F.round(F.avg(x), 6).alias("avg_time"), F.count(x).alias("runs"), F.round(F.count(x) / F.nullif(F.sum(x), F.lit(0.0)), 6).alias("qps")
    )


def quantiles(rows: DataFrame, latency: str, by: list[str]) -> DataFrame:
    """Mean, p95 and p99 (exclusive) of each group, of any size."""
    means = rows.groupBy(*by).agg(F.round(F.avg(latency), 6).alias("mean_time"))
    return means.join(ranked_quantiles(rows, latency, by), by).select(*by, "mean_time", "p95", "p99")


def ranked_quantiles(rows: DataFrame, latency: str, by: list[str] | None = None) -> DataFrame:
    """p95 and p99 (exclusive) of a whole table or of its groups: values are counted, counts summed in order, and only the cut's neighbours kept.

    No task orders a whole group: prefix sums run over coarse bins of the value first, then inside each bin. A group
    has some thousand bins at most.
    """
    by = by or []
    freq = rows.filter(F.col(latency).isNotNull()).groupBy(*by, latency).agg(F.count(F.lit(1)).alias("c"))
    binned = freq.withColumn("bin", F.floor(F.log2(1 + F.abs(F.col(latency))) * 64) * F.signum(latency))
    inside = Window.partitionBy(*by)
    per_bin = binned.groupBy(*by, "bin").agg(F.sum("c").alias("bc"))
    per_bin = per_bin.select(*by, "bin", (F.sum("bc").over(inside.orderBy("bin")) - F.col("bc")).alias("before"), F.sum("bc").over(inside).alias("total"))
    run = Window.partitionBy(*by, "bin").orderBy(latency)
    placed = binned.join(per_bin, [*by, "bin"]).withColumn("hi", F.col("before") + F.sum("c").over(run))

    def cut(i: int, n: int) -> tuple[Column, Column]:
        at = F.greatest(F.lit(1), F.least(F.floor(i * (F.col("total") + 1) / n), F.col("total") - 1))
        return at, i * (F.col("total") + 1) - at * n

    out = []
    for i, n in ((19, 20), (99, 100)):
        at, delta = cut(i, n)
        low = F.max(F.when((F.col("hi") >= at) & (F.col("hi") - F.col("c") < at), F.col(latency)))
        high = F.max(F.when((F.col("hi") >= at + 1) & (F.col("hi") - F.col("c") < at + 1), F.col(latency)))
        d = F.max(delta)
        out.append(F.round((low * (n - d) + F.coalesce(high, low) * d) / n, 6).alias(f"p{100 * i // n}"))
    return placed.groupBy(*by).agg(*out)


def tumbling(rows: DataFrame, latency: str, hit: Column, width: str, ts: str = "ts") -> DataFrame:
    """Mean, p95 and hit rate of each tumbling window that has rows."""
    windowed = rows.select(F.window(F.col(ts).cast("timestamp"), width)["start"].alias("window_start"), F.col(latency).alias("x"), hit.cast("int").alias("hit"))
    agg = windowed.groupBy("window_start").agg(F.count(F.lit(1)).alias("n_queries"), F.round(F.avg("x"), 6).alias("avg_time"), F.round(F.avg("hit"), 6).alias("hit_rate"))
    cuts = ranked_quantiles(windowed, "x", ["window_start"]).drop("p99")
    return agg.join(cuts, "window_start", "left").select("window_start", "n_queries", "avg_time", "p95", "hit_rate")


def shard_timings(each: DataFrame, pos: str = "pos", time: str = "t") -> DataFrame:
    """Mean and p95 by position in a query's list of shard times, which is the order of completion; a row a shard and query."""
    return quantiles(each, time, [pos]).select(F.col(pos).alias("pos"), "mean_time", "p95")


def improvement(engine: DataFrame, baseline: DataFrame, by: str) -> DataFrame:
    """Baseline over engine for times, engine over baseline for throughput."""
    e, b = (x.select(by, F.col("avg_time").alias(f"{n}_time"), F.col("qps").alias(f"{n}_qps")) for x, n in ((engine, "e"), (baseline, "b")))
    return e.join(b, by).select(by, F.round(F.col("b_time") / F.nullif("e_time", F.lit(0.0)), 6).alias("time_ratio"), F.round(F.col("e_qps") / F.nullif("b_qps", F.lit(0.0)), 6).alias("qps_ratio"))
