"""Synthetic corpora and queries, a row at a time from ``range``; equal seeds give equal tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import seeded_hash

WORD_LENGTH = 5
#: Digits to the base 26, and the letters that stand for them.
DIGITS, LETTERS = "0123456789ABCDEFGHIJKLMNOP", "abcdefghijklmnopqrstuvwxyz"
# The vocabulary of the small test corpus.
FRUIT = "apple banana cherry date elderberry fig grape honeydew kiwi lemon".split()


def _uniform(seed: int, *parts: Column) -> Column:
    """0 <= x < 1, a function of the seed and the parts."""
    return seeded_hash(seed, F.concat_ws(":", *[p.cast("string") for p in parts])) / float(2**32)


def _word(seed: int, *parts: Column) -> Column:
    """Five letters: the digits of one hash to the base 26."""
    h = seeded_hash(seed, F.concat_ws(":", *[p.cast("string") for p in parts]))
    return F.translate(F.lpad(F.conv((h % 26**WORD_LENGTH).cast("string"), 10, 26), WORD_LENGTH, "0"), DIGITS, LETTERS)


def uniform_documents(spark: SparkSession, n: int, length: int = 100, seed: int = 42) -> DataFrame:
    """``doc_id, content, terms``: up to ``length`` distinct random words a document."""
    words = F.array_sort(F.array_distinct(F.transform(F.sequence(F.lit(1), F.lit(length)), lambda j: _word(seed, F.col("id"), j))))
    return spark.range(n).select(F.col("id").alias("doc_id"), words.alias("terms")).select("doc_id", F.array_join("terms", " ").alias("content"), "terms")


def uniform_queries(spark: SparkSession, n: int, words: int = 3, seed: int = 43) -> DataFrame:
    picked = F.transform(F.sequence(F.lit(1), F.lit(words)), lambda j: _word(seed, F.col("id"), j))
    return spark.range(n).select(F.col("id").alias("query_id"), F.array_join(picked, " ").alias("query"))


def vocabulary(spark: SparkSession, size: int, seed: int = 44) -> DataFrame:
    """``rank, word``: words for ranks of a Zipf law; which rank is drawn follows from the law's inverse, see ``zipf_rank``."""
    return spark.range(1, size + 1).select(F.col("id").alias("rank"), _word(seed, F.col("id")).alias("word"))


def zipf_rank(u: Column, size: int, exponent: float = 1.5) -> Column:
    """The rank for a uniform draw: the inverse of the continuous law on [1, size + 1), rounded down."""
    a = 1.0 - exponent
    return F.least(F.lit(size), F.floor((1 + u * ((size + 1.0) ** a - 1)) ** (1 / a))).cast("bigint")


def zipf_documents(spark: SparkSession, n: int, size: int = 100_000, mean: float = 100, deviation: float = 20, exponent: float = 1.5, seed: int = 45) -> DataFrame:
    """``doc_id, content, terms`` of max(10, normal) draws from a Zipf vocabulary; words are functions of their rank, so nothing is joined."""
    u1, u2 = F.greatest(_uniform(seed, F.col("id"), F.lit("a")), F.lit(1e-12)), _uniform(seed, F.col("id"), F.lit("b"))
    normal = F.sqrt(-2 * F.log(u1)) * F.cos(6.283185307179586 * u2)
    length = F.greatest(F.lit(10), F.floor(mean + deviation * normal)).cast("int")
    words = F.transform(F.sequence(F.lit(1), length), lambda j: _word(44, zipf_rank(_uniform(seed, F.col("id"), j), size, exponent)))
    return spark.range(n).select(F.col("id").alias("doc_id"), F.array_sort(F.array_distinct(words)).alias("terms")).select("doc_id", F.array_join("terms", " ").alias("content"), "terms")


def zipf_queries(spark: SparkSession, n: int, words: int = 3, size: int = 100_000, exponent: float = 1.5, seed: int = 46) -> DataFrame:
    picked = F.transform(F.sequence(F.lit(1), F.lit(words)), lambda j: _word(44, zipf_rank(_uniform(seed, F.col("id"), j), size, exponent)))
    return spark.range(n).select(F.col("id").alias("query_id"), F.array_join(picked, " ").alias("query"))


def _pick(seed: int, *parts: Column) -> Column:
    return F.element_at(F.array(*[F.lit(w) for w in FRUIT]), (F.floor(len(FRUIT) * _uniform(seed, *parts)) + 1).cast("int"))


def fruit_documents(spark: SparkSession, n: int = 1000, seed: int = 42) -> DataFrame:
    """``content_id, content``: 20 to 99 words with repetition from ten."""
    count = (20 + F.floor(80 * _uniform(seed, F.col("id"), F.lit("n")))).cast("int")
    words = F.transform(F.sequence(F.lit(1), count), lambda j: _pick(seed, F.col("id"), j))
    return spark.range(n).select(F.concat(F.lit("doc_"), F.col("id")).alias("content_id"), F.array_join(words, " ").alias("content"))


def fruit_queries(spark: SparkSession, n: int = 100, seed: int = 43) -> DataFrame:
    count = (2 + F.floor(3 * _uniform(seed, F.col("id"), F.lit("n")))).cast("int")
    words = F.transform(F.sequence(F.lit(1), count), lambda j: _pick(seed, F.col("id"), j))
    return spark.range(n).select(F.col("id").alias("query_id"), F.array_join(words, " ").alias("query"))
