"""Pattern search: cosine over pattern features, blended with signature agreement and access counts.

A stated set of queries meets all documents, in blocks; see ``blocks``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import seeded_hash, signature_words
from . import blocks

#: Bits of the stored signature: 100 and 4 of padding, in chunks of 32.
STORED_BITS = 104
CHUNK_BITS = (32, 32, 32, 8)
_CHUNKS = [f"c{i}" for i in range(4)]
#: Queries of a block.
MAX_QUERIES = 2_000


def signatures(pattern: DataFrame) -> DataFrame:
    """``key, c0, c1, c2, c3``: the signature's chunks."""
    return with_signatures(pattern).select("key", *_CHUNKS)


def with_signatures(pattern: DataFrame) -> DataFrame:
    """``pattern`` with the columns of ``signatures``, which ``features`` has written already."""
    return pattern if "c0" in pattern.columns else pattern.withColumns(dict(zip(_CHUNKS, signature_words(F.col("canonical")), strict=True)))


def shard_of(chunks: list[Column], shards: int) -> Column:
    return F.pmod(seeded_hash(0, F.concat_ws("-", *[c.cast("string") for c in chunks])), F.lit(shards)).cast("int")


def rank_shards(access: DataFrame, probability: Column, shards: int) -> DataFrame:
    """``shard_id, score``: the max(3, shards / 10) best by probability times ln(1 + accesses), ties to the higher id."""
    scored = access.select("shard_id", F.round(probability * F.log1p("accesses"), 6).alias("score"))
    return scored.orderBy(F.desc("score"), F.desc("shard_id")).limit(max(3, shards // 10))


def _equal(batch: pa.RecordBatch, asked: np.ndarray) -> list[np.ndarray]:
    """Differing bits of each chunk, as (documents, queries) matrices."""
    own = blocks.words(batch, _CHUNKS)
    return [np.bitwise_count(own[:, None, i] ^ asked[None, :, i]).astype(np.float64) for i in range(len(_CHUNKS))]


def explores(differing: list[np.ndarray], access: np.ndarray) -> np.ndarray:
    """Whether a walk down the chunks reaches a document: from the third chunk on, equal bits must reach max(0.7 - depth / 10, 0.3), less what accesses add."""
    keep = np.ones(differing[0].shape, bool)
    for depth in range(2, len(differing)):
        keep &= 1 - differing[depth] / CHUNK_BITS[depth] + np.log1p(access)[:, None] / 10 >= max(0.7 - 0.1 * depth, 0.3) - 1e-12
    return keep


def _cosine(block: pa.Table):
    """Cosines of ``patterns`` rows; a zero norm gives none."""
    terms = pa.array(sorted({t for row in block.column("weights").to_pylist() for t, _ in row}), pa.string())
    w = blocks.weights(block.column("weights").combine_chunks(), terms).T
    stats, norm = blocks.lists(block.column("stats")).T, block.column("norm").to_numpy()

    def run(batch: pa.RecordBatch) -> np.ndarray:
        dot = blocks.weights(batch.column("weights"), terms) @ w + blocks.lists(batch.column("stats")) @ stats
        size = np.multiply.outer(batch.column("norm").to_numpy(zero_copy_only=False), norm)
        return np.divide(dot, size, out=np.full(dot.shape, np.nan), where=size > 0)

    return run


def _named(found: DataFrame, key: str = "doc_id", others: tuple[str, ...] = ()) -> DataFrame:
    return found.select("query_id", F.col("key").alias(key), "score", *others, "rank")


_PATTERN = ("key", "weights", "stats", "norm")


def cosine_search(docs: DataFrame, queries: DataFrame, k: int = 10, min_similarity: float = 0.5) -> DataFrame:
    """``query_id, doc_id, score, rank`` of the k nearest documents with a cosine of ``min_similarity`` or more; both sides are ``patterns`` rows."""

    def scorer(block: pa.Table):
        cosine = _cosine(block)

        def run(batch: pa.RecordBatch):
            cos = cosine(batch)
            return np.where(blocks.half_up(cos) >= min_similarity, cos, np.nan), []

        return run

    return _named(blocks.best_of(docs.select(*_PATTERN), blocks.query_blocks(queries.select(*_PATTERN), "key", MAX_QUERIES), scorer, k))


def pattern_search(
    docs: DataFrame, queries: DataFrame, access: DataFrame | None = None, k: int = 10, min_similarity: float = 0.5, shards: DataFrame | None = None, shard_count: int = 100, content: DataFrame | None = None
) -> DataFrame:
    """``query_id, doc_id, score, pattern_match, access_count, rank``: 0.6 cosine + 0.3 equal bits + 0.1 ln(1 + accesses).

    ``docs`` and ``queries`` are ``patterns`` rows, with or without their signatures; ``access`` has ``key, access_count``. All shards are
    searched unless ``shards`` (shard_id, of ``rank_shards``) names some of ``shard_count``. ``content`` (key, content) adds the found texts.
    """
    d, q = with_signatures(docs), with_signatures(queries)
    if shards is not None:
        # rank_shards gives max(3, shards / 10) rows at most.
        d = d.withColumn("shard_id", shard_of([F.col(c) for c in _CHUNKS], shard_count)).join(F.broadcast(shards.select("shard_id")), "shard_id", "left_semi")
    if access is not None:
        d = d.join(access.select("key", "access_count"), "key", "left").withColumn("access_count", F.coalesce("access_count", F.lit(0)).cast("double"))
    else:
        d = d.withColumn("access_count", F.lit(0.0))

    def scorer(block: pa.Table):
        cosine, asked = _cosine(block), blocks.words(block, _CHUNKS)

        def run(batch: pa.RecordBatch):
            cos, access = cosine(batch), batch.column("access_count").to_numpy(zero_copy_only=False)
            differing = _equal(batch, asked)
            match = 1 - sum(differing) / STORED_BITS
            kept = (blocks.half_up(cos) >= min_similarity) & explores(differing, access)
            score = 0.6 * cos + 0.3 * match + 0.1 * np.log1p(access)[:, None]
            return np.where(kept, score, np.nan), [match, np.broadcast_to(access[:, None], match.shape)]

        return run

    others = ("pattern_match", "access_count")
    found = blocks.best_of(d.select(*_PATTERN, *_CHUNKS, "access_count"), blocks.query_blocks(q.select(*_PATTERN, *_CHUNKS), "key", MAX_QUERIES), scorer, k, others)
    out = _named(found, "doc_id", others).withColumns({"pattern_match": F.round("pattern_match", 6), "access_count": F.col("access_count").cast("bigint")})
    # The found rows are k a query at most, and the queries have been on the driver: the texts stay where they lie.
    return out if content is None else content.select(F.col("key").alias("doc_id"), "content").join(F.broadcast(out), "doc_id").select(*out.columns, "content")


def signature_search(docs: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """``query_id, doc_id, score, rank`` by equal signature bits; both sides are ``signatures`` rows."""

    def scorer(block: pa.Table):
        asked = blocks.words(block, _CHUNKS)
        return lambda batch: (1 - sum(_equal(batch, asked)) / STORED_BITS, [])

    return _named(blocks.best_of(docs.select("key", *_CHUNKS), blocks.query_blocks(queries.select("key", *_CHUNKS), "key", MAX_QUERIES), scorer, k))


def visits(docs: DataFrame, queries: DataFrame) -> DataFrame:
    """``query_id, visited, documents``: how many documents a walk reaches for each query; both sides are ``signatures`` rows."""

    def scorer(block: pa.Table):
        asked = blocks.words(block, _CHUNKS)
        return lambda batch: (np.where(explores(_equal(batch, asked), np.zeros(batch.num_rows)), 0.0, np.nan), [])

    return blocks.counts_of(docs.select("key", *_CHUNKS), blocks.query_blocks(queries.select("key", *_CHUNKS), "key", MAX_QUERIES), scorer).withColumnRenamed("counted", "visited")


def vector_search(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """``query_id, vec_id, score, rank`` by cosine of dense vectors of one length; ``queries`` has ``query_id, q``. Zero vectors have no cosine."""

    def scorer(block: pa.Table):
        q = blocks.lists(block.column("q"))
        nq = np.linalg.norm(q, axis=1)

        def run(batch: pa.RecordBatch):
            v = blocks.lists(batch.column("embedding"))
            size = np.multiply.outer(np.linalg.norm(v, axis=1), nq)
            dot = v @ q.T
            return np.divide(dot, size, out=np.full(dot.shape, np.nan), where=size > 0), []

        return run

    return _named(blocks.best_of(vectors.select("vec_id", "embedding"), blocks.query_blocks(queries.select("query_id", "q"), "query_id", MAX_QUERIES), scorer, k), "vec_id")


__all__ = ["cosine_search", "explores", "pattern_search", "rank_shards", "shard_of", "signature_search", "signatures", "vector_search", "visits", "with_signatures"]
