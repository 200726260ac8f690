"""A stored inverted index: built once, read by every search.

``build_index`` writes, below ``path/version=N``:

* ``postings``: ``shard_id, term, doc_id`` over all documents, partitioned by shard_id and sorted by (term, doc_id), so that a search
  reads the shards and row groups of its terms alone. Rows are dealt by ranges of (shard_id, term, doc_id): a term that
  most documents hold spreads over many files.
* ``terms``: ``shard_id, term, df, doc_ids``: document frequency over all postings, and the lowest ``limit`` ids.
* ``bloom``: the words of a filter over all terms, sized for their number, if a false-positive rate is given.
* ``meta``: one row with the sizes, written last; a version without it does not count.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.storage import write
from . import bloom
from .cache import ResultCache
from .index import POSTING_LIMIT, capped_postings, term_table

SHARDS = 16
_META = "version bigint, documents bigint, terms bigint, shards int, posting_limit int, bits bigint, hashes int, id_type string"


def shard_of(term: Column, shards: int) -> Column:
    return F.pmod(F.crc32(F.encode(term, "UTF-8")), F.lit(shards)).cast("int")


def build_index(docs: DataFrame, path: str, version: int = 1, shards: int = SHARDS, limit: int = POSTING_LIMIT, false_positives: float | None = None) -> Index:
    """Write the index of ``docs`` (doc_id, text) and open it."""
    spark, home = docs.sparkSession, f"{path}/version={version}"
    pairs = term_table(docs).withColumn("shard_id", shard_of(F.col("term"), shards))
    order = ["shard_id", "term", "doc_id"]
    _write(pairs.select(*order).repartitionByRange(*order).sortWithinPartitions(*order), f"{home}/postings", "shard_id")
    kind = docs.schema["doc_id"].dataType.simpleString()
    stored = spark.read.schema(_schemas(kind)["postings"]).parquet(f"{home}/postings")
    df = stored.groupBy("shard_id", "term").agg(F.count(F.lit(1)).alias("df"))
    ids = capped_postings(stored, limit).groupBy("term").agg(F.sort_array(F.collect_list("doc_id")).alias("doc_ids"))
    lists = df.join(ids, "term").select("shard_id", "term", "df", "doc_ids")
    _write(lists.repartition("shard_id", F.pmod(F.xxhash64("term"), F.lit(8))).sortWithinPartitions("shard_id", "term"), f"{home}/terms", "shard_id")
    terms = spark.read.schema(_schemas(kind)["terms"]).parquet(f"{home}/terms")
    n = terms.count()
    size = bloom.size_for(n, false_positives, 1) if false_positives else bloom.Size(0, 0)
    if false_positives:
        _write(bloom.build(terms.select("term"), size), f"{home}/bloom")
    total = docs.agg(F.count(F.lit(1)).alias("documents"))
    facts = total.select(F.lit(version).alias("version"), "documents", F.lit(n).alias("terms"), F.lit(shards).alias("shards"), F.lit(limit).alias("posting_limit"), F.lit(size.bits).alias("bits"), F.lit(size.hashes).alias("hashes"), F.lit(kind).alias("id_type"))
    _write(facts.select(*[F.col(c.split()[0]).cast(c.split()[1]) for c in _META.split(", ")]), f"{home}/meta")
    return Index(spark, path, version)


def _schemas(id_type: str) -> dict[str, str]:
    """What the tables hold; a table without rows tells no schema."""
    return {
        "postings": f"term string, doc_id {id_type}, shard_id int",
        "terms": f"term string, df bigint, doc_ids array<{id_type}>, shard_id int",
        "bloom": "word_idx bigint, word bigint",
        "meta": _META,
    }


def _write(df: DataFrame, path: str, by: str | None = None) -> None:
    write(df, path, **({"partitionBy": by} if by else {}))


def open_index(spark: SparkSession, path: str) -> Index:
    """The highest complete version below ``path``."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    whole = [int(n.removeprefix("version=")) for n in names if n.startswith("version=") and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/meta/_SUCCESS"))]
    if not whole:
        raise FileNotFoundError(f"no complete index below {path}")
    return Index(spark, path, max(whole))


@dataclass(frozen=True)
class Index:
    spark: SparkSession
    path: str
    version: int

    def _read(self, name: str) -> DataFrame:
        schema = _META if name == "meta" else _schemas(self.meta["id_type"])[name]
        return self.spark.read.schema(schema).parquet(f"{self.path}/version={self.version}/{name}")

    @cached_property
    def meta(self) -> dict:
        return self._read("meta").first().asDict()

    @cached_property
    def postings(self) -> DataFrame:
        return self._read("postings").select("shard_id", "term", "doc_id")

    @cached_property
    def terms(self) -> DataFrame:
        return self._read("terms").select("shard_id", "term", "df", "doc_ids")

    @property
    def bloom_size(self) -> bloom.Size:
        return bloom.Size(self.meta["bits"], self.meta["hashes"])

    @cached_property
    def bloom_words(self) -> DataFrame:
        return self._read("bloom")

    def known(self, asked: DataFrame) -> DataFrame:
        """The rows of ``asked`` whose term passes the filter: none that the index holds is lost."""
        seen = bloom.probe(asked.select("term").distinct(), self.bloom_words, self.bloom_size).filter("maybe")
        return asked.join(seen.select("term"), "term", "left_semi")

    def hits(self, asked: DataFrame, limit: int | None = POSTING_LIMIT) -> DataFrame:
        """``query_id, term, df, doc_id``: the postings of the asked terms (query_id, term), the lowest ``limit`` of each."""
        placed = asked.withColumn("shard_id", shard_of(F.col("term"), self.meta["shards"]))
        met = placed.join(self.terms, ["shard_id", "term"])
        if limit is not None and limit <= self.meta["posting_limit"]:
            return met.select("query_id", "term", "df", F.explode(F.slice("doc_ids", 1, limit)).alias("doc_id"))
        found = met.select("query_id", "shard_id", "term", "df").join(self.postings, ["shard_id", "term"])
        return capped_postings_of(found, limit).select("query_id", "term", "df", "doc_id")

    def lists_of(self, query: str) -> DataFrame:
        """``term, df, doc_ids`` of one query's terms: shards and terms are literals, so only their partitions and row groups are read."""
        words = sorted({w for w in re.split(r"[ \t\n\x0b\f\r]+", query.lower()) if w})
        shards = sorted({zlib.crc32(w.encode()) % self.meta["shards"] for w in words})
        return self.terms.filter(F.col("shard_id").isin(shards) & F.col("term").isin(words)).select("term", "df", "doc_ids")

    def search(self, query: str, k: int = 100, cache: ResultCache | None = None) -> DataFrame:
        """``doc_id, score, rank`` of one query by the sum of 1 / df; a cache answers a query it has seen at this version."""
        if cache is not None and (found := cache.get(query, k, self.version)) is not None:
            return found
        rows = self.lists_of(query).select((1.0 / F.col("df")).alias("w"), F.explode("doc_ids").alias("doc_id"))
        scored = rows.groupBy("doc_id").agg(F.round(F.sum("w"), 6).alias("score")).orderBy(F.desc("score"), "doc_id").limit(k)
        ranked = scored.agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("neg"), "doc_id"))).alias("top"))
        out = ranked.select(F.posexplode("top").alias("pos", "t")).select("t.doc_id", (-F.col("t.neg")).alias("score"), (F.col("pos") + 1).cast("bigint").alias("rank"))
        return out if cache is None else cache.put(query, k, out, self.version)


def capped_postings_of(found: DataFrame, limit: int | None) -> DataFrame:
    """``found`` cut to the lowest ``limit`` documents of each query's term."""
    if limit is None:
        return found
    w = Window.partitionBy("query_id", "term").orderBy("doc_id")
    return found.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= limit).drop("rn")
