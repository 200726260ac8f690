"""Queries over access history, latencies and the cache; ``events`` serves as the log: value as latency, views as cache hits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import access, cache, metrics
from ..sources.tables import table

AS_OF = "2024-01-31 00:00:00"
#: Decay per second, and the horizon of five mean lifetimes.
DECAY = 1e-5
HORIZON = 5 / DECAY
CAPACITY, TTL = 100, 20 * 86400.0


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", F.col("ts").cast("timestamp").alias("ts"))


def access_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = access.counts(_events(spark, sf_dir), "user_id")
    return c.select("user_id", "access_count", F.unix_micros("last_access").alias("last_access"))


def access_decay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access.decayed(_events(spark, sf_dir), "user_id", F.lit(AS_OF), DECAY)


def access_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access.decayed(_events(spark, sf_dir), "user_id", F.lit(AS_OF), DECAY, horizon=HORIZON)


def latency_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.summary(_events(spark, sf_dir), "value", ["event_type"])


def latency_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.quantiles(_events(spark, sf_dir), "value", ["event_type"])


def latency_quantiles_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.ranked_quantiles(_events(spark, sf_dir), "value")


def cache_hit_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).groupBy("user_id").agg(F.round(F.avg((F.col("event_type") == "view").cast("int")), 6).alias("hit_rate"))


def _tumbling(spark: SparkSession, sf_dir: str, width: str) -> DataFrame:
    out = metrics.tumbling(_events(spark, sf_dir), "value", F.col("event_type") == "view", width)
    return out.withColumn("window_start", F.unix_micros("window_start"))


def metrics_tumbling_60s(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tumbling(spark, sf_dir, "60 seconds")


def metrics_tumbling_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tumbling(spark, sf_dir, "1 day")


def shard_timings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The values of one user and type, by time, as one query's shard times."""
    order = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    return metrics.shard_timings(_events(spark, sf_dir).select((F.row_number().over(order) - 1).alias("pos"), F.col("value").alias("t")))


def improvement_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir)
    return metrics.improvement(metrics.summary(e.filter("event_type = 'view'"), "value", ["user_id"]), metrics.summary(e.filter("event_type = 'click'"), "value", ["user_id"]), "user_id")


def _puts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).select(F.concat_ws("-", F.col("user_id").cast("string"), "event_type").alias("query"), F.col("ts").alias("put_ts"))


def cache_fifo_ttl(spark: SparkSession, sf_dir: str) -> DataFrame:
    live = cache.live_entries(_puts(spark, sf_dir), F.lit(AS_OF), CAPACITY, TTL)
    return live.withColumn("put_ts", F.unix_micros("put_ts"))


def cache_eviction_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = _puts(spark, sf_dir).groupBy("query").agg(F.max("put_ts").alias("put_ts"))
    return cache.eviction_order(last).withColumn("put_ts", F.unix_micros("put_ts"))


QUERIES = {
    f.__name__: f
    for f in (
        access_counts, access_decay, access_recent, latency_summary, latency_quantiles, latency_quantiles_all, cache_hit_rate, metrics_tumbling_60s, metrics_tumbling_1d,
        shard_timings, improvement_ratio, cache_fifo_ttl, cache_eviction_order,
    )
}

_AGE = f"((epoch_us(TIMESTAMP '{AS_OF}') - epoch_us(ts)) / 1e6)"


def _quantile(i: int, n: int) -> str:
    """The i-th of n - 1 exclusive cuts of the sorted list xs."""
    at = f"greatest(1, least({i} * (len(xs) + 1) // {n}, len(xs) - 1))"
    return f"round(CASE WHEN len(xs) = 1 THEN xs[1] ELSE (xs[{at}] * ({n} - ({i} * (len(xs) + 1) - {at} * {n})) + xs[{at} + 1] * ({i} * (len(xs) + 1) - {at} * {n})) / {n} END, 6)"


_SUMMARY = "round(min(value), 6) AS min_time, round(max(value), 6) AS max_time, round(avg(value), 6) AS avg_time, count(value) AS runs, round(count(value) / nullif(sum(value), 0), 6) AS qps"
_LAST = "last AS (SELECT user_id || '-' || event_type AS query, max(ts) AS ts FROM events GROUP BY 1)"


def _tumbling_sql(seconds: int) -> str:
    return f"""WITH w AS (SELECT epoch_us(ts) // {seconds * 10**6} * {seconds * 10**6} AS window_start, list(value ORDER BY value) AS xs, avg(value) AS m, avg(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END) AS h, count(*) AS n_queries FROM events GROUP BY 1)
SELECT window_start, n_queries, round(m, 6) AS avg_time, {_quantile(19, 20)} AS p95, round(h, 6) AS hit_rate FROM w"""


SQL = {
    "access_counts": "SELECT user_id, count(*) AS access_count, epoch_us(max(ts)) AS last_access FROM events GROUP BY user_id",
    "access_decay": f"SELECT user_id, round(sum(exp(-{DECAY} * {_AGE})), 6) AS weight FROM events WHERE {_AGE} >= 0 GROUP BY user_id",
    "access_recent": f"SELECT user_id, round(sum(exp(-{DECAY} * {_AGE})), 6) AS weight FROM events WHERE {_AGE} >= 0 AND {_AGE} < {HORIZON} GROUP BY user_id",
    "latency_summary": f"SELECT event_type, {_SUMMARY} FROM events GROUP BY event_type",
    "latency_quantiles": f"WITH g AS (SELECT event_type, list(value ORDER BY value) AS xs, avg(value) AS m FROM events GROUP BY 1) SELECT event_type, round(m, 6) AS mean_time, {_quantile(19, 20)} AS p95, {_quantile(99, 100)} AS p99 FROM g",
    "latency_quantiles_all": f"WITH g AS (SELECT list(value ORDER BY value) AS xs FROM events) SELECT {_quantile(19, 20)} AS p95, {_quantile(99, 100)} AS p99 FROM g",
    "cache_hit_rate": "SELECT user_id, round(avg(CASE WHEN event_type = 'view' THEN 1 ELSE 0 END), 6) AS hit_rate FROM events GROUP BY user_id",
    "metrics_tumbling_60s": _tumbling_sql(60),
    "metrics_tumbling_1d": _tumbling_sql(86400),
    "shard_timings": f"""WITH e AS (SELECT CAST(row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) - 1 AS INTEGER) AS pos, value FROM events),
g AS (SELECT pos, list(value ORDER BY value) AS xs, avg(value) AS m FROM e GROUP BY pos) SELECT pos, round(m, 6) AS mean_time, {_quantile(19, 20)} AS p95 FROM g""",
    "improvement_ratio": f"""WITH s AS (SELECT user_id, event_type, {_SUMMARY} FROM events GROUP BY ALL)
SELECT e.user_id, round(b.avg_time / nullif(e.avg_time, 0), 6) AS time_ratio, round(e.qps / nullif(b.qps, 0), 6) AS qps_ratio FROM s e JOIN s b ON e.user_id = b.user_id AND e.event_type = 'view' AND b.event_type = 'click'""",
    "cache_fifo_ttl": f"WITH {_LAST} SELECT query, epoch_us(ts) AS put_ts FROM last WHERE {_AGE} <= {TTL} AND {_AGE} >= 0 ORDER BY ts DESC, query LIMIT {CAPACITY}",
    "cache_eviction_order": f"WITH {_LAST} SELECT query, epoch_us(ts) AS put_ts, row_number() OVER (ORDER BY ts DESC, query) AS rn FROM last",
}
