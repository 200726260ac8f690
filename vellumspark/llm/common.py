"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.storage import Scope, discard, materialize

#: A word is a maximal run of bytes that are no ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: The row number that stands for doc_ids that are null or repeated; no input has such a column.
ROW_NO = "_vellum_row"


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def columns(df: DataFrame, **wanted: str) -> DataFrame:
    """Only the wanted columns under the operators' own names, so that extra columns cannot clash."""
    return df.select(*[df[source].alias(name) for name, source in wanted.items()])


def unique_ids(docs: DataFrame, doc_id: str = "doc_id") -> bool:
    """Whether no doc_id is null or repeated; one grouping of the ids alone."""
    return not docs.groupBy(doc_id).count().filter(F.col(doc_id).isNull() | (F.col("count") > 1)).head(1)


def numbered_if_odd(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` and ``doc_id``, or, where doc_ids are null or repeated, ``docs`` with a row number and its name."""
    if unique_ids(docs):
        return docs, "doc_id"
    return numbered(docs, ROW_NO), ROW_NO


def numbered(rows: DataFrame, name: str = "row_no") -> DataFrame:
    """``rows`` with a row number, counting in order of doc_id (null first) and text; the driver sees one count a partition.

    Equal rows are told apart by where they were read, so that any number of them spreads over many ranges.
    """
    order = [F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first(), F.col("_vellum_read")]
    read = rows.withColumn("_vellum_read", F.monotonically_increasing_id())
    ranged = read.repartitionByRange(shuffle_partitions(rows.sparkSession), *order).sortWithinPartitions(*order)
    dealt = materialize(ranged.select(*rows.columns, F.spark_partition_id().alias("_vellum_part"), F.monotonically_increasing_id().alias("_vellum_at")))
    first = dealt.groupBy("_vellum_part").agg(F.count(F.lit(1)).alias("c"), F.min("_vellum_at").alias("least")).orderBy("_vellum_part").collect()
    before, offsets = 0, {}
    for r in first:
        offsets[r["_vellum_part"]] = before - r["least"]
        before += r["c"]
    if not offsets:
        return rows.withColumn(name, F.lit(0).cast("long"))
    shift = F.create_map(*[F.lit(x) for kv in offsets.items() for x in kv])
    return dealt.select(*rows.columns, (F.col("_vellum_at") + shift[F.col("_vellum_part")]).cast("long").alias(name))


__all__ = ["WORD", "Scope", "ascii_lower", "columns", "discard", "materialize", "numbered", "numbered_if_odd", "shuffle_partitions", "table", "unique_ids"]
