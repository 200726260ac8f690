"""The best documents of each of a stated set of queries, by scores of whole blocks.

Queries come in blocks of bounded size; each block goes to the tasks once, as Arrow data, and meets every document where it lies. A
task scores an Arrow batch against a block with matrix arithmetic and keeps the best k of each query, so no pair ever
becomes a row, nothing but k rows a query leaves a task, and any number of queries is answered, a block after the other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Pairs that are scored at once.
PAIRS = 1 << 21

#: From a slice of documents to a (documents, queries) array of scores, not a number for pairs that do not count, and further such arrays.
Score = Callable[[pa.RecordBatch], tuple[np.ndarray, list[np.ndarray]]]


def query_blocks(queries: DataFrame, key: str, size: int) -> list[pa.Table]:
    """The queries as Arrow tables of about ``size`` rows, in order of ``key``."""
    n = -(-queries.count() // size)
    parts = [queries] if n <= 1 else [queries.filter(F.pmod(F.xxhash64(key), F.lit(n)) == b) for b in range(n)]
    return [t.sort_by(key) for t in (p.toArrow() for p in parts)]


def half_up(x: np.ndarray, digits: int = 6) -> np.ndarray:
    return np.sign(x) * np.floor(np.abs(x) * 10**digits + 0.5) / 10**digits


def _best(scores: np.ndarray, k: int, order: np.ndarray) -> np.ndarray:
    """Indices of the k highest scores; of those equal to the last of them, the lowest by ``order``, the keys' places when sorted."""
    valid = np.flatnonzero(~np.isnan(scores))
    if len(valid) <= k:
        return valid
    x = scores[valid]
    last = np.partition(x, len(x) - k)[len(x) - k]
    above, ties = valid[x > last], valid[x == last]
    left = k - len(above)
    return np.concatenate([above, ties if len(ties) <= left else ties[np.argpartition(order[ties], left - 1)[:left]]])


def _keep(k: int, queries: int, score: Score):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[list[tuple]] = [[] for _ in range(queries)]
        kind = None
        step = max(1, PAIRS // max(1, queries))
        for batch in batches:
            kind = batch.schema.field(0).type
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                scores, others = score(part)
                scores, keys = np.asfortranarray(half_up(scores)), part.column(0)
                order = np.empty(len(keys), np.int64)
                order[pc.array_sort_indices(keys).to_numpy()] = np.arange(len(keys))
                for q in range(queries):
                    rows = _best(scores[:, q], k, order)
                    if len(rows):
                        found[q] += [(-scores[i, q], keys[int(i)].as_py(), *(o[i, q] for o in others)) for i in rows]
                        if len(found[q]) > 4 * k:
                            found[q] = sorted(found[q], key=lambda r: r[:2])[:k]
        rows = [(q, -r[0], *r[1:]) for q in range(queries) for r in sorted(found[q], key=lambda r: r[:2])[:k]]
        if rows:
            q, s, keys, *others = zip(*rows, strict=True)
            extra = [pa.array(np.asarray(o, float), pa.float64()) for o in others]
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(s, pa.float64()), pa.array(keys, kind), *extra], names=["no", "score", "key", *[f"x{i}" for i in range(len(extra))]])

    return run


def best_of(docs: DataFrame, blocks: list[pa.Table], scorer: Callable[[pa.Table], Score], k: int, others: tuple[str, ...] = ()) -> DataFrame:
    """``query_id, key, score, rank`` and the ``others`` of the best k documents of each query; ties go to the lower key.

    ``docs`` has its key first; a block's key is its first column; ``scorer`` makes a block's scoring function.
    """
    spark, kind = docs.sparkSession, docs.schema[0].dataType.simpleString()
    parts = []
    for block in blocks:
        extra = "".join(f", x{i} double" for i in range(len(others)))
        rows = docs.mapInArrow(_keep(k, block.num_rows, scorer(block)), f"no int, score double, key {kind}{extra}")
        w = Window.partitionBy("no").orderBy(F.desc("score"), "key")
        top = rows.withColumn("rank", F.row_number().over(w).cast("bigint")).filter(F.col("rank") <= k)
        ids = spark.createDataFrame(pa.table({"no": pa.array(range(block.num_rows), pa.int32()), "query_id": block.column(0)}))
        parts.append(top.join(F.broadcast(ids), "no").select("query_id", "key", F.round("score", 6).alias("score"), *[F.col(f"x{i}").alias(o) for i, o in enumerate(others)], "rank"))
    return reduce(DataFrame.unionByName, parts)


def counts_of(docs: DataFrame, blocks: list[pa.Table], scorer: Callable[[pa.Table], Score]) -> DataFrame:
    """``query_id, counted, documents``: with how many documents each query's score is a number."""
    spark, parts = docs.sparkSession, []

    def tally(queries: int, score: Score):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            counted, n = np.zeros(queries, np.int64), 0
            step = max(1, PAIRS // max(1, queries))
            for batch in batches:
                for at in range(0, batch.num_rows, step):
                    counted += (~np.isnan(score(batch.slice(at, step))[0])).sum(axis=0)
                n += batch.num_rows
            yield pa.RecordBatch.from_arrays([pa.array(range(queries), pa.int32()), pa.array(counted), pa.array(np.full(queries, n))], names=["no", "c", "n"])

        return run

    for block in blocks:
        sums = docs.mapInArrow(tally(block.num_rows, scorer(block)), "no int, c long, n long").groupBy("no").agg(F.sum("c").alias("counted"), F.sum("n").alias("documents"))
        ids = spark.createDataFrame(pa.table({"no": pa.array(range(block.num_rows), pa.int32()), "query_id": block.column(0)}))
        parts.append(sums.join(F.broadcast(ids), "no").select("query_id", "counted", "documents"))
    return reduce(DataFrame.unionByName, parts)


def lists(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A column of lists of one length as a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def weights(column: pa.Array, terms: pa.Array) -> np.ndarray:
    """A column of maps as a (rows, terms) matrix; other terms are left out."""
    out = np.zeros((len(column), len(terms)))
    if len(column) and len(terms):
        offsets = column.offsets.to_numpy()
        keys, items = (x[offsets[0] : offsets[-1]] for x in (column.keys, column.items))
        code = pc.fill_null(pc.index_in(keys, value_set=terms), -1).to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(len(column)), np.diff(offsets))
        known = code >= 0
        out[row[known], code[known]] = items.to_numpy(zero_copy_only=False)[known]
    return out


def shared(asked: pa.Array | pa.ChunkedArray, weight: Callable[[pa.Array], np.ndarray] | None = None) -> Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]:
    """From a column of sets of words to two (rows, asked) matrices: how many words a row shares with each asked set, and the sum of those words' weights.

    Only the words that a row shares with a set are visited.
    """
    asked = asked.combine_chunks() if isinstance(asked, pa.ChunkedArray) else asked
    size = len(asked)
    coded = asked.flatten().cast(pa.string()).dictionary_encode()
    terms, codes = coded.dictionary, coded.indices.to_numpy()
    owner = np.repeat(np.arange(size), pc.list_value_length(asked).to_numpy(zero_copy_only=False))[np.argsort(codes, kind="stable")]
    starts = np.concatenate([[0], np.cumsum(np.bincount(codes, minlength=len(terms)))])
    w = np.ones(len(terms)) if weight is None else weight(terms)

    def run(sets: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        code = pc.fill_null(pc.index_in(sets.flatten().cast(pa.string()), value_set=terms), -1).to_numpy(zero_copy_only=False)
        known = code >= 0
        row, code = np.repeat(np.arange(len(sets)), pc.list_value_length(sets).to_numpy(zero_copy_only=False))[known], code[known]
        n = starts[code + 1] - starts[code]
        ends = np.cumsum(n)
        at = np.repeat(starts[code] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)
        cell = np.repeat(row, n) * size + owner[at]
        shape = (len(sets), size)
        counts = np.bincount(cell, minlength=len(sets) * size).reshape(shape)
        return counts, counts if weight is None else np.bincount(cell, np.repeat(w[code], n), len(sets) * size).reshape(shape)

    return run


def words(batch: pa.RecordBatch | pa.Table, names: list[str]) -> np.ndarray:
    """Columns of 32-bit words as a (rows, columns) matrix."""
    return np.stack([np.asarray(batch.column(n).to_numpy(zero_copy_only=False) if isinstance(batch, pa.RecordBatch) else batch.column(n).to_numpy()).astype(np.uint32) for n in names], axis=1)
