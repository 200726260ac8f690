"""Reading tables, and the query log that the queries use."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import terms

#: Below so many bytes a core, a table is dealt out anew.
SPLIT_BYTES = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def input_bytes(df: DataFrame) -> int:
    """The optimiser's estimate of the bytes that ``df`` reads: file sizes for a scan. Nothing runs for it."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def spread(df: DataFrame) -> DataFrame:
    """``df`` dealt over all cores where its files don't give them even work: it is small, or few row groups, which no scan splits, hold most of it."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = input_bytes(df)
    if size >= SPLIT_BYTES * cores:
        rows = _split_rows(df, size)
        # A core's even share at most, so that no task takes longer than all should; a shuffle of the texts gains nothing then.
        if cores * max(rows, default=0) <= sum(rows):
            return df
    return df.repartition(max(cores, -(-size // SPLIT_BYTES)))


def _split_rows(df: DataFrame, size: int) -> list[int]:
    """The rows of each split of a scan, from the files' footers: no column is read. Counted once a session, plan and size."""
    key = (df.sparkSession.sparkContext.applicationId, df.semanticHash(), size)
    if key not in _splits:
        counted = df.select(F.spark_partition_id().alias("p")).groupBy("p").agg(F.count(F.lit(1)).alias("n"))
        _splits[key] = [r["n"] for r in counted.collect()]
    return _splits[key]


_splits: dict[tuple, list[int]] = {}


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"))


def query_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``query_id, query``: the first three terms of each benchmark text."""
    words = F.slice(terms(F.col("text")), 1, 3)
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.array_join(words, " ").alias("query"))
