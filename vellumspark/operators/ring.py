"""Consistent hashing: a ring of virtual nodes, lookups of the next node, balance reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.hashing import seeded_hash

VIRTUAL_NODES = 100
#: Lookups are bucketed by so many upper bits of the hash, so that each key meets few intervals.
BUCKET_BITS = 8
SPACE = 2**32


def ring(spark: SparkSession, shards: int, virtual: int = VIRTUAL_NODES) -> DataFrame:
    """``pos, shard_id``; its size is shards times virtual nodes."""
    nodes = spark.range(shards).select(F.col("id").cast("int").alias("shard_id")).crossJoin(spark.range(virtual).select(F.col("id").alias("v")))
    pos = seeded_hash(0, F.concat_ws(":", F.col("shard_id").cast("string"), F.col("v").cast("string")))
    return nodes.select(pos.alias("pos"), "shard_id")


def _intervals(ring_table: DataFrame) -> DataFrame:
    """``low, high, shard_id, bucket``: keys in (low, high] belong to the shard; the first node also takes what follows the last."""
    w = Window.orderBy("pos", "shard_id")
    nodes = ring_table.withColumn("low", F.coalesce(F.lag("pos").over(w), F.lit(-1)))
    first = ring_table.orderBy("pos", "shard_id").limit(1).select("shard_id")
    last = ring_table.agg(F.max("pos").alias("low"))
    wrap = last.crossJoin(first).select("low", F.lit(SPACE).alias("high"), "shard_id")
    spans = nodes.select("low", F.col("pos").alias("high"), "shard_id").unionByName(wrap).filter("high > low")
    step = SPACE >> BUCKET_BITS
    return spans.withColumn("bucket", F.explode(F.sequence(F.floor((F.col("low") + 1) / step), F.floor(F.least(F.col("high"), F.lit(SPACE - 1)) / step))))


def lookup(keys: DataFrame, ring_table: DataFrame, key: str = "term") -> DataFrame:
    """``keys`` with ``shard_id``: the first node at or after the key's hash, else the first of the ring.

    Keys and intervals meet by the hash's upper bits: an equi-join, not every key with every node. Each key falls into just one interval.
    """
    step = SPACE >> BUCKET_BITS
    hashed = keys.withColumn("_h", seeded_hash(0, F.col(key))).withColumn("bucket", F.floor(F.col("_h") / step))
    spans = F.broadcast(_intervals(ring_table))
    return hashed.join(spans, "bucket").filter("_h > low and _h <= high").drop("_h", "bucket", "low", "high")


def shard_distribution(placed: DataFrame) -> DataFrame:
    """``shard_id, n_terms`` of non-empty shards."""
    return placed.groupBy("shard_id").agg(F.count(F.lit(1)).alias("n_terms"))


def balance(distribution: DataFrame) -> DataFrame:
    """Mean, sample deviation and count over non-empty shards."""
    return distribution.agg(F.count(F.lit(1)).alias("shards"), F.round(F.avg("n_terms"), 6).alias("mean_terms"), F.round(F.stddev_samp("n_terms"), 6).alias("stddev_terms"))
