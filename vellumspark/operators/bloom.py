"""Bloom filters as tables of 32-bit words: single, cascaded, sharded."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import seeded_hash
from ..sources.storage import materialize


@dataclass(frozen=True)
class Size:
    bits: int
    hashes: int


def size_for(items: int, false_positives: float, least_hashes: int = 0) -> Size:
    """m = floor(-n ln p / ln(2)^2), k = floor(m / n ln 2)."""
    n = max(1, items)
    bits = max(1, int(-n * math.log(false_positives) / math.log(2) ** 2))
    return Size(bits, max(least_hashes, int(bits / n * math.log(2))))


def size_columns(n: Column, p: Column) -> tuple[Column, Column]:
    """The same as column expressions."""
    bits = F.floor(-n * F.log(p) / (F.log(F.lit(2.0)) * F.log(F.lit(2.0)))).cast("bigint")
    return bits, F.floor(bits / n * F.log(F.lit(2.0))).cast("bigint")


def cascade_sizes(items: int, first: float = 0.1, levels: int = 4) -> list[Size]:
    return [size_for(items, first * 0.5**level, 1) for level in range(levels)]


def positions(term: Column, size: Size) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(size.hashes - 1)), lambda i: F.pmod(seeded_hash(i, term), F.lit(size.bits)))


def _hashed(terms: DataFrame, hashes: int, by: list[str]) -> DataFrame:
    """``terms`` (term and the ``by`` columns) with ``k, h``: a row for each of the term's hashes."""
    return terms.select(*by, "term", F.explode(F.sequence(F.lit(0), F.lit(hashes - 1))).alias("k")).withColumn("h", seeded_hash(F.col("k"), F.col("term")))


def _words(bits: DataFrame, by: list[str]) -> DataFrame:
    """``[by,] word_idx, word`` of positions; partial ORs run before the shuffle."""
    word = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod("pos", F.lit(32)).cast("int"))
    return bits.groupBy(*by, "word_idx").agg(F.bit_or(word).alias("word"))


def _word_idx() -> Column:
    return F.floor(F.col("pos") / 32).cast("bigint")


def build(terms: DataFrame, size: Size, by: list[str] | None = None) -> DataFrame:
    """``[by,] word_idx, word``: the filter's words that have a bit."""
    by = by or []
    return _words(_hashed(terms, size.hashes, by).select(*by, F.pmod("h", F.lit(size.bits)).alias("pos")).withColumn("word_idx", _word_idx()), by)


def _level_bits(terms: DataFrame, sizes: list[Size]) -> DataFrame:
    """``level, pos, word_idx`` of all filters of a cascade: the hashes do not depend on the level, so each is computed once."""
    places = F.array(*[F.struct(F.lit(i).alias("level"), F.pmod("h", F.lit(s.bits)).alias("pos"), F.lit(s.hashes).alias("hashes")) for i, s in enumerate(sizes)])
    rows = _hashed(terms, max(s.hashes for s in sizes), []).select("k", F.explode(places).alias("p"))
    return rows.filter("k < p.hashes").select("p.level", "p.pos").withColumn("word_idx", _word_idx())


def probe(asked: DataFrame, words: DataFrame, size: Size, by: list[str] | None = None) -> DataFrame:
    """``asked`` (term and the ``by`` columns) with ``maybe``: whether all its bits are set. Only the probed words are read."""
    by = by or []
    bits = asked.select(*by, "term", F.explode(positions(F.col("term"), size)).alias("pos")).withColumn("word_idx", F.floor(F.col("pos") / 32).cast("bigint"))
    met = bits.join(words, [*by, "word_idx"], "left")
    bit = F.call_function("shiftright", F.coalesce("word", F.lit(0).cast("bigint")), F.pmod("pos", F.lit(32)).cast("int")).bitwiseAND(F.lit(1).cast("bigint")) == 1
    return met.groupBy(*by, "term").agg(F.bool_and(bit).alias("maybe"))


def cascade_probe(asked: DataFrame, terms: DataFrame, sizes: list[Size]) -> DataFrame:
    """``term, maybe``: a term must pass every level; terms that one level denies are not probed further.

    The filters are built in one pass over the terms; of their words only those are put together that an asked term can probe.
    """
    left, denied = asked.select("term").distinct(), None
    probed = _level_bits(left, sizes).select("level", "word_idx").distinct()
    built = materialize(_words(_level_bits(terms, sizes).join(probed, ["level", "word_idx"], "left_semi"), ["level"]))
    for i, size in enumerate(sizes):
        seen = probe(left, built.filter(F.col("level") == i).drop("level"), size)
        no = seen.filter(~F.col("maybe"))
        denied = no if denied is None else denied.unionByName(no)
        left = seen.filter("maybe").select("term")
    return left.withColumn("maybe", F.lit(True)).unionByName(denied)


def bloom_shard(term: Column, shards: int) -> Column:
    return F.pmod(seeded_hash(-1, term), F.lit(shards)).cast("int")
