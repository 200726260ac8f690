"""Language identification by nearest centroid.

A text becomes a normalised TF-IDF vector of hashed byte 1- to 4-grams of its lower-case words. Each language has several centroids
(spherical k-means over its training texts); a text gets the language of the centroid with the greatest cosine.
A text that is farther from every centroid than nearly all training texts of its amount of evidence are from theirs is
marked as rejected: a short text has few n-grams and so a small cosine with anything, for which it is not blamed.

The model is fitted on a sample of about ``PER_LANG`` labelled texts of every language: those whose hash lies below a threshold that
follows from the language's count, so nothing is ranked. Document frequencies are a grouping, each language is
clustered in a task of its own, and the driver receives one idf vector and the centroids (``DIMS * CENTROIDS`` floats a language).
Prediction covers every whole text.

Defined cases: a null text or one without a letter is ``und`` with score 0 and is rejected; null labels teach nothing; equal texts of one
language teach once; equal cosines go to the language first by name; without any labelled text all is ``und``; repeated
rows are kept; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import columns, materialize, table

#: Hashed dimensions, n-gram lengths in bytes, centroids a language, k-means rounds.
DIMS, GRAMS, CENTROIDS, ROUNDS = 1 << 15, (1, 2, 3, 4), 4, 12
#: Training texts a language, on average over hashes; a language with fewer gives all.
PER_LANG = 400
#: Bytes of centroids that the driver and every worker can hold; more languages than that are an error, not left out.
MODEL_BYTES = 1 << 30
#: A text is rejected if its cosine over ``evidence`` is below this share of the least ones in training (their 0.5 % quantile).
REJECT_SHARE, REJECT_QUANTILE = 0.5, 0.005
#: Distinct n-grams from which a text's cosine is taken as it is.
FULL_EVIDENCE = 256
OUT_ROWS = 512

_LETTERS = regex.compile(r"\p{L}+")
_MULT = [np.uint32(m) for m in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F)]


def _codes(text: str) -> np.ndarray:
    """The hashed n-grams of a text's words, a blank before and after each."""
    data = np.frombuffer((" " + " ".join(_LETTERS.findall(text.lower())) + " ").encode("utf-8", "surrogatepass"), np.uint8).astype(np.uint32)
    shift, out, code = np.uint32(32 - DIMS.bit_length() + 1), [], np.zeros(len(data), np.uint32)
    for n in GRAMS:
        if len(data) < n:
            break
        code = (code[: len(data) - n + 1] << np.uint32(8)) | data[n - 1 :]
        out.append((code * _MULT[n - 1] + np.uint32(n)) >> shift)
    return np.concatenate(out)


def vector(text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
    """(codes, counts) of a text, or None where it has no letter."""
    if not text or not _LETTERS.search(text):
        return None
    counts = np.bincount(_codes(text), minlength=DIMS)
    codes = np.flatnonzero(counts)
    return codes.astype(np.int32), counts[codes].astype(np.float32)


def evidence(n_grams: int) -> float:
    """What the cosine of a text of so many distinct n-grams is measured by: it grows with their square root until it is 1."""
    return min(1.0, (n_grams / FULL_EVIDENCE) ** 0.5)


@dataclass(frozen=True)
class Model:
    langs: tuple[str, ...]
    idf: np.ndarray  #: (DIMS,)
    centroids: np.ndarray  #: (DIMS, n): unit columns
    owner: np.ndarray  #: (n,): each centroid's language
    reject_below: float

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        found = vector(text)
        if found is None or not self.langs:
            return "und", 0.0, True
        codes, counts = found
        w = np.log1p(counts) * self.idf[codes]
        norm = float(np.sqrt(np.dot(w, w)))
        if not norm:
            return self.langs[0], 0.0, True
        cos = (w @ self.centroids[codes]) / norm
        k = int(np.argmax(cos))
        score = float(min(1.0, max(0.0, cos[k])))
        return self.langs[self.owner[k]], score, score < self.reject_below * evidence(len(codes))


def _cluster(x: np.ndarray, k: int) -> np.ndarray:
    """Spherical k-means: the first seed is the text nearest the mean, each further one the text farthest from the seeds so far."""
    mean = x.mean(axis=0)
    seeds = [int(np.argmax(x @ mean))]
    near = x @ x[seeds[0]]
    while len(seeds) < min(k, len(x)):
        seeds.append(int(np.argmin(near)))
        near = np.maximum(near, x @ x[seeds[-1]])
    c = x[seeds]
    for _ in range(ROUNDS):
        at = np.argmax(x @ c.T, axis=1)
        new = np.stack([x[at == j].sum(axis=0) if (at == j).any() else c[j] for j in range(len(c))])
        new /= np.maximum(np.linalg.norm(new, axis=1, keepdims=True), 1e-12)
        if np.allclose(new, c, atol=1e-6):
            break
        c = new
    return c


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, OUT_ROWS):
            part = batch.slice(at, OUT_ROWS)
            found = [(lang, v[0].tobytes(), v[1].tobytes()) for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True) if (v := vector(text)) is not None]
            yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.string()), *[pa.array([f[k] for f in found], pa.binary()) for k in (1, 2)]], names=["lang", "codes", "counts"])


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """How many of a task's texts hold each n-gram; code -1 counts the texts."""
    df, n = np.zeros(DIMS, np.int64), 0
    for batch in batches:
        for codes in batch.column(0).to_pylist():
            df[np.frombuffer(codes, np.int32)] += 1
            n += 1
    if n:
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1).astype(np.int32)), pa.array(np.append(df[at], n))], names=["code", "c"])


def _clustered(idf: np.ndarray):
    """A language's sample to its centroids, and each text's cosine to the nearest of them over its evidence."""

    def run(sample: pa.Table) -> pa.Table:
        rows = sorted(zip(sample.column("codes").to_pylist(), sample.column("counts").to_pylist(), strict=True))
        x = np.zeros((len(rows), DIMS), np.float32)
        for i, (codes, counts) in enumerate(rows):
            at = np.frombuffer(codes, np.int32)
            x[i, at] = np.log1p(np.frombuffer(counts, np.float32)) * idf[at]
        x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        c = _cluster(x, CENTROIDS)
        near = np.sort((x @ c.T).max(axis=1) / [evidence(len(codes) // 4) for codes, _ in rows])
        return pa.table([sample.column("lang").slice(0, 1), pa.array([c.astype("<f4").tobytes()], pa.binary()), pa.array([near], pa.list_(pa.float64()))], names=["lang", "centroids", "near"])

    return run


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", per_lang: int = PER_LANG) -> Model:
    """A model from labelled documents; rows with a null label are left out."""
    rows = columns(docs, doc_id=doc_id, text=text, lang=lang).filter("lang is not null and text is not null")
    # A written table of one row a language: its size is known when the join is planned.
    share = materialize(rows.groupBy("lang").agg((F.lit(float(per_lang)) / F.count(F.lit(1))).alias("share")))
    drawn = F.pmod(F.xxhash64("doc_id", "text"), F.lit(2**40)) / F.lit(2.0**40)
    sample = rows.withColumn("drawn", drawn).join(share.withColumnRenamed("lang", "of"), (F.col("lang") == F.col("of")) & (F.col("drawn") < F.col("share")))
    sample = materialize(sample.select("lang", "text").mapInArrow(_features, "lang string, codes binary, counts binary").distinct())
    df = sample.select("codes").mapInArrow(_frequencies, "code int, c long").groupBy("code").agg(F.sum("c").alias("c")).toArrow()
    seen = np.zeros(DIMS + 1)
    seen[df.column("code").to_numpy()] = df.column("c").to_numpy()
    if not seen[-1]:
        return Model((), np.zeros(DIMS, np.float32), np.zeros((DIMS, 0), np.float32), np.zeros(0, np.int64), 0.0)
    idf = (np.log((1 + seen[-1]) / (1 + seen[:DIMS])) + 0.05).astype(np.float32)
    known = sample.select("lang").distinct().count()
    if known * CENTROIDS * DIMS * 4 > MODEL_BYTES:
        raise ValueError(f"{known} languages need more than {MODEL_BYTES} bytes of centroids: lower DIMS or CENTROIDS")
    found = sample.groupBy("lang").applyInArrow(_clustered(idf), "lang string, centroids binary, near array<double>").toArrow()
    order = np.argsort(np.array(found.column("lang").to_pylist(), object))
    parts = [np.frombuffer(found.column("centroids")[int(k)].as_buffer(), "<f4").reshape(-1, DIMS) for k in order]
    near = np.concatenate([found.column("near")[int(k)].values.to_numpy() for k in order])
    return Model(
        tuple(found.column("lang")[int(k)].as_py() for k in order),
        idf,
        np.ascontiguousarray(np.concatenate(parts).T),
        np.repeat(np.arange(len(parts)), [len(c) for c in parts]),
        REJECT_SHARE * float(np.quantile(near, REJECT_QUANTILE)),
    )


def predict(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score, rejected`` of each document; the text alone decides."""
    rows = columns(docs, doc_id=doc_id, text=text)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, OUT_ROWS):
                part = batch.slice(at, OUT_ROWS)
                said = [m.predict(t) for t in part.column(1).to_pylist()]
                cols = [pa.array(c, t) for c, t in zip(zip(*said, strict=True), (pa.string(), pa.float64(), pa.bool_()), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), *cols], names=["doc_id", "lang_pred", "score", "rejected"])

    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double, rejected boolean")


def with_language(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with columns ``lang_pred, lang_score, lang_rejected``, which replace columns of those names."""
    docs = docs.drop("lang_pred", "lang_score", "lang_rejected")
    at = docs.columns.index(text)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for lo in range(0, batch.num_rows, OUT_ROWS):
                part = batch.slice(lo, OUT_ROWS)
                said = [m.predict(t) for t in part.column(at).to_pylist()]
                cols = [pa.array(c, t) for c, t in zip(zip(*said, strict=True), (pa.string(), pa.float64(), pa.bool_()), strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, *cols], names=[*part.schema.names, "lang_pred", "lang_score", "lang_rejected"])

    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("lang_score", T.DoubleType()), T.StructField("lang_rejected", T.BooleanType())])
    return docs.mapInArrow(run, schema)


def held_out():
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(docs.filter(~held_out()))
    said = predict(docs, model)
    return said.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")
