"""The stored index and pattern features of a folder's documents, built by the first query that reads them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..operators import features, pattern
from ..operators.index import term_frequency
from ..operators.store import Index, build_index
from ..sources.storage import materialize, new_path
from ..sources.tables import documents, input_bytes, query_log, table

#: False-positive rate of the stored filter.
FALSE_POSITIVES = 0.01


@dataclass(frozen=True)
class Patterns:
    """Written tables: ``patterns`` rows with their signatures, of documents and of the query log."""

    vocabulary: DataFrame
    documents: DataFrame
    queries: DataFrame


_built: dict[tuple, Index] = {}
_terms: dict[tuple, DataFrame] = {}
_signatures: dict[tuple, tuple[DataFrame, DataFrame]] = {}
_patterns: dict[tuple, Patterns] = {}


def _key(spark: SparkSession, sf_dir: str) -> tuple:
    return (spark.sparkContext.applicationId, sf_dir, input_bytes(table(spark, sf_dir, "documents")), input_bytes(table(spark, sf_dir, "benchmark")))


def stored_patterns(spark: SparkSession, sf_dir: str) -> Patterns:
    """Built once a session, folder and size of its tables."""
    key = _key(spark, sf_dir)
    if key not in _patterns:
        docs = documents(spark, sf_dir)
        vocabulary = materialize(features.fit_vocabulary(docs))
        made = [materialize(pattern.with_signatures(features.patterns(rows, vocabulary, *names))) for rows, *names in ((docs, "doc_id"), (query_log(spark, sf_dir), "query_id", "query"))]
        _patterns[key] = Patterns(vocabulary, *made)
    return _patterns[key]


def stored_signatures(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """``signatures`` rows of documents and of the query log: those of the pattern features if they are built, else from the texts alone, without a vocabulary."""
    key = _key(spark, sf_dir)
    if key in _patterns:
        return _patterns[key].documents, _patterns[key].queries
    if key not in _signatures:
        sides = ((documents(spark, sf_dir), "doc_id"), (query_log(spark, sf_dir), "query_id", "query"))
        _signatures[key] = tuple(materialize(pattern.signatures(features.canonical_forms(rows, *names))) for rows, *names in sides)
    return _signatures[key]


def stored_index(spark: SparkSession, sf_dir: str) -> Index:
    """Built once a session, folder and size of its tables."""
    key = _key(spark, sf_dir)
    if key not in _built:
        _built[key] = build_index(documents(spark, sf_dir), new_path(spark, "index"), false_positives=FALSE_POSITIVES)
    return _built[key]


def built_index(spark: SparkSession, sf_dir: str) -> Index | None:
    """The stored index, if a query has built it."""
    return _built.get(_key(spark, sf_dir))


def stored_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``term, df`` of all terms: the stored index's if it is built, else from one grouping of the texts, without lists or postings."""
    key = _key(spark, sf_dir)
    if key in _built:
        return _built[key].terms.select("term", "df")
    if key not in _terms:
        _terms[key] = materialize(term_frequency(documents(spark, sf_dir)))
    return _terms[key]


def forget() -> None:
    """The next query builds anew."""
    _built.clear()
    _patterns.clear()
    _signatures.clear()
    _terms.clear()
