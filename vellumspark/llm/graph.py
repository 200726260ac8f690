"""Connected components of an edge table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialize

#: A node is a hub from so many edges on, and as many more as leaves at most MAX_HUBS hubs; a hub's edges are dealt to SALTS tasks.
HUB, MAX_HUBS, SALTS = 8192, 1000, 16


def _with_least(edges: DataFrame, least: DataFrame, total: int) -> DataFrame:
    """``edges`` (u, v) with column m of ``least`` (u, m, d); hubs, of which there are MAX_HUBS at most, are spread by a salt."""
    if total <= HUB:
        return edges.join(least, "u").select("u", "v", "m")
    is_hub = F.col("d") > max(HUB, total // MAX_HUBS)
    hubs = F.broadcast(least.filter(is_hub).select("u", F.lit(SALTS).alias("salts")))
    left = edges.join(hubs, "u", "left").withColumn("salt", F.pmod(F.xxhash64("v"), F.coalesce("salts", F.lit(1))).cast("int"))
    right = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.when(is_hub, SALTS - 1).otherwise(0))))
    return left.join(right, ["u", "salt"]).select("u", "v", "m")


def _large_star(edges: DataFrame, total: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("d")).select("u", F.least("u", "m").alias("m"), "d")
    # Only larger neighbours are hung on the least one.
    moved = _with_least(both.filter("v > u"), least, 2 * total)
    return moved.select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct()


def _small_star(edges: DataFrame, total: int) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("d"))
    moved = _with_least(down, least, total).filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).filter("u > v").distinct()


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, u: str = "u", v: str = "v", max_rounds: int = 100) -> DataFrame:
    """``(node, component)`` for each node of an edge; the component is its least node.

    Null ends and self-loops bind nothing; repeated and reversed edges count once; an empty table gives
    an empty one. Each round shuffles the edges a few times and is written to the shared folder, so that
    a lost executor costs one round; the number of rounds grows with the logarithm of the diameter.
    """
    e = edges.select(F.col(u).alias("u"), F.col(v).alias("v")).filter("u is not null and v is not null and u <> v")
    now = materialize(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = _digest(now)
    if not seen[0]:
        return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    for _ in range(max_rounds):
        then, now = now, materialize(_small_star(_large_star(now, seen[0]), seen[0]))
        last, seen = seen, _digest(now)
        discard(then)
        if last == seen:
            roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
