"""The corpus pipeline: five stages over documents, each reading what the one before has written."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellumspark.llm import bpe, language_id, minhash, mixing, substring_dedup
from vellumspark.llm.common import Scope, discard, materialize

#: Similarity of word shingles, in per cent, from which the stage takes documents for near-duplicates.
NEAR_PERCENT = 80

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language the centroids do not reject; ``lang`` becomes the predicted language.

    Null texts and texts without a letter are rejected; repeated rows, null ids and other columns stay as they are.
    """
    model = language_id.fit(docs.filter(~language_id.held_out()))
    return language_id.with_language(docs, model).filter(~F.col("lang_rejected")).select(*[F.col("lang_pred").alias("lang") if c == "lang" else F.col(c) for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the first by doc_id; texts without words all stay."""
    return minhash.one_of_each(docs, NEAR_PERCENT)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the strings of 100 bytes that occur before; texts that end up empty go.

    Rows of null or repeated doc_ids count as documents of their own; a null text stays null.
    """
    cut = substring_dedup.remove_repeats(docs, keep_text=True, carry=[c for c in docs.columns if c not in ("doc_id", "text", "n_chars")])
    cut = cut.filter("n_removed = 0 or kept_text <> ''")
    return cut.select(*[{"text": F.col("kept_text").alias("text"), "n_chars": F.length("kept_text").cast("long").alias("n_chars")}.get(c, F.col(c)) for c in docs.columns])


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; a null source is a source of its own, rows of one doc_id are taken one by one."""
    return mixing.expand_copies(docs)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each copy's text, with digests of the ids and of the bytes that they decode to."""
    return bpe.encode(docs, *bpe.default_vocabulary(), keep_ids=True)


STAGES: list[tuple[str, Stage]] = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("suffix_array_dedup", cut_repeats),
    ("source_mixing", mix_sources),
    ("byte_bpe", encode_tokens),
]

#: Nearest centroids, entropy balancing and BPE are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each one's result is written to the shared folder and read again.

    What a stage wrote on its way, and what it read, is deleted as soon as its result is there.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        with Scope() as scope:
            done = materialize(stage(spark, docs, sf_dir))
        scope.discard(done)
        discard(docs)
        docs = done
    return STAGES[-1][1](spark, docs, sf_dir)
