"""Queries over the inverted index, Bloom filters and the ring."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import terms
from ..operators import bloom, index, ring, search
from ..sources.tables import documents, query_log, table
from .indexes import stored_index, stored_terms
from .sql import ASKED, CAP, DF, LOG, TERMS, TOK, h

FALSE_POSITIVES, SUB_SHARDS = 0.01, 4
SHARDS = 16
#: The cascade's first rate and its levels; each level halves the rate.
FIRST_RATE, LEVELS = 0.1, 4


def tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = documents(spark, sf_dir).select("doc_id", terms(F.col("text")).alias("ts"))
    return rows.select("doc_id", F.size("ts").cast("bigint").alias("n_terms"), F.size(F.array_distinct("ts")).cast("bigint").alias("n_distinct"), F.md5(F.array_join("ts", " ")).alias("terms_md5"))


def distinct_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.term_table(documents(spark, sf_dir)).groupBy("term").agg(F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))


def postings_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.capped_postings(index.term_table(documents(spark, sf_dir)))


def document_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.term_frequency(documents(spark, sf_dir))


def exact_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One term's list, read from its shard of the stored index alone."""
    found = stored_index(spark, sf_dir).lists_of("the")
    return found.select(F.explode("doc_ids").alias("doc_id"), "term")


def postings_sharded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms are counted before they are placed, so that no task takes the postings of a whole shard."""
    frequencies = index.term_frequency(documents(spark, sf_dir))
    placed = index.with_shard(frequencies, SHARDS, bloom.bloom_shard(F.col("term"), SHARDS))
    return placed.groupBy("shard_id").agg(F.sum("df").alias("n_postings"), F.min("term").alias("first_term"), F.max("term").alias("last_term"))


def live_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = stored_index(spark, sf_dir).terms.select("term", F.explode("doc_ids").alias("doc_id"))
    return search.live_postings(stored, table(spark, sf_dir, "labels").filter("toxic = 0")).select("term", "doc_id")


def latest_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return index.latest_version(rows, "conv_id", "turn")


def bloom_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = stored_terms(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"))
    rates = n.select("n", F.explode(F.array(*[F.lit(p) for p in (0.1, 0.05, 0.025, 0.0125, 0.01)])).alias("p"))
    bits, hashes = bloom.size_columns(F.col("n").cast("double"), F.col("p"))
    return rates.select("n", "p", bits.alias("bits"), hashes.alias("hashes"))


def _distinct(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    """The distinct terms and their number, by which filters are sized."""
    known = stored_terms(spark, sf_dir).select("term")
    return known, known.count()


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.query_terms(query_log(spark, sf_dir)).select("term").distinct()


def bloom_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    known, n = _distinct(spark, sf_dir)
    return bloom.build(known, bloom.size_for(n, FALSE_POSITIVES, 1))


def bloom_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored filter, probed."""
    stored = stored_index(spark, sf_dir)
    return bloom.probe(_asked(spark, sf_dir), stored.bloom_words, stored.bloom_size)


def cascade_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    known, n = _distinct(spark, sf_dir)
    return bloom.cascade_probe(_asked(spark, sf_dir), known, bloom.cascade_sizes(n, FIRST_RATE, LEVELS))


def sharded_bloom_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    known, n = _distinct(spark, sf_dir)
    size, shard = bloom.size_for(n // SUB_SHARDS, FALSE_POSITIVES, 1), bloom.bloom_shard(F.col("term"), SUB_SHARDS)
    built = bloom.build(known.withColumn("bloom_shard", shard), size, ["bloom_shard"])
    return bloom.probe(_asked(spark, sf_dir).withColumn("bloom_shard", shard), built, size, ["bloom_shard"])


def ring_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ring.ring(spark, SHARDS)


def ring_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ring.lookup(stored_terms(spark, sf_dir).select("term"), ring.ring(spark, SHARDS))


def shard_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = ring.lookup(stored_terms(spark, sf_dir), ring.ring(spark, SHARDS))
    return placed.groupBy("shard_id").agg(F.sum("df").alias("n_terms"))


def shard_balance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ring.balance(shard_distribution(spark, sf_dir))


QUERIES = {
    f.__name__: f
    for f in (
        tokenize, distinct_terms, postings_capped, document_frequency, exact_lookup, postings_sharded, live_postings, latest_version, bloom_size,
        bloom_bits, bloom_probe, cascade_probe, sharded_bloom_probe, ring_positions, ring_lookup, shard_distribution, shard_balance,
    )
}


def _size_sql(name: str, p: float, items: str = "count(*)") -> str:
    """A filter's size from the number of terms, as ``size_for`` has it."""
    return f"""{name}_m AS (SELECT n, CAST(greatest(1, floor(-n * ln({p}::DOUBLE) / (ln(2) * ln(2)))) AS BIGINT) AS bits FROM (SELECT greatest(1, {items}) AS n FROM terms)),
{name}_size AS (SELECT bits, CAST(greatest(1, floor(bits / n * ln(2))) AS BIGINT) AS hashes FROM {name}_m)"""


def _pos_sql(source: str, name: str) -> str:
    return f"(SELECT *, {h('k', 'term')} % bits AS p FROM (SELECT s.*, bits, unnest(range(hashes)) AS k FROM {source} s, {name}_size))"


def _build_sql(name: str = "words", by: str = "") -> str:
    lead = f"{by}, " if by else ""
    return f"{name} AS (SELECT {lead}p // 32 AS word_idx, bit_or(1::BIGINT << CAST(p % 32 AS INTEGER)) AS word FROM {_pos_sql('terms', name)} GROUP BY ALL)"


def _probe_sql(name: str = "words", by: str = "") -> str:
    lead, on = (f"a.{by}, ", f"w.{by} = a.{by} AND ") if by else ("", "")
    return f"""SELECT {lead}term, bool_and((coalesce(word, 0) >> CAST(p % 32 AS INTEGER)) & 1 = 1) AS maybe
FROM {_pos_sql('wanted', name)} a LEFT JOIN {name} w ON {on}w.word_idx = p // 32 GROUP BY ALL"""


_RATES = [FIRST_RATE * 0.5**level for level in range(LEVELS)]
TERMS_CTE = "terms AS (SELECT DISTINCT term FROM tok)"
WANTED = "wanted AS (SELECT DISTINCT term FROM asked)"
RING = f"ring AS (SELECT {h('0', 's::VARCHAR || chr(58) || v::VARCHAR')} AS pos, CAST(s AS INTEGER) AS shard_id FROM range({SHARDS}) a(s), range({ring.VIRTUAL_NODES}) b(v))"
LOOKUP = f"""hashed AS (SELECT term, {h('0', 'term')} AS hh FROM terms),
placed AS (SELECT term, coalesce(shard_id, (SELECT shard_id FROM ring ORDER BY pos, shard_id LIMIT 1)) AS shard_id FROM hashed ASOF LEFT JOIN ring ON hh <= pos)"""
_N_TERMS = f"n_terms AS (SELECT shard_id, CAST(sum(df) AS BIGINT) AS n_terms FROM placed JOIN df USING (term) GROUP BY shard_id)"

SQL = {
    "tokenize": f"SELECT doc_id, CAST(len(ts) AS BIGINT) AS n_terms, CAST(len(list_distinct(ts)) AS BIGINT) AS n_distinct, md5(array_to_string(ts, ' ')) AS terms_md5 FROM (SELECT doc_id, {TERMS('text')} AS ts FROM documents)",
    "distinct_terms": f"WITH {TOK} SELECT term, min(doc_id) AS first_doc, max(doc_id) AS last_doc FROM tok GROUP BY term",
    "postings_capped": f"WITH {TOK}, {CAP} SELECT doc_id, term FROM cap",
    "document_frequency": f"WITH {TOK}, {DF} SELECT term, df FROM df",
    "exact_lookup": f"WITH {TOK}, {CAP} SELECT doc_id, term FROM cap WHERE term = 'the'",
    "postings_sharded": f"WITH {TOK} SELECT CAST({h('-1', 'term')} % {SHARDS} AS INTEGER) AS shard_id, count(*) AS n_postings, min(term) AS first_term, max(term) AS last_term FROM tok GROUP BY 1",
    "live_postings": f"WITH {TOK}, {CAP} SELECT term, doc_id FROM cap WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 0)",
    "latest_version": "SELECT conv_id, turn, role, text FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) = 1",
    "bloom_size": f"""WITH {TOK}, n AS (SELECT count(DISTINCT term) AS n FROM tok), m AS (SELECT n, p, CAST(floor(-n * ln(p) / (ln(2) * ln(2))) AS BIGINT) AS bits
FROM n, (VALUES (0.1::DOUBLE), (0.05::DOUBLE), (0.025::DOUBLE), (0.0125::DOUBLE), (0.01::DOUBLE)) v(p)) SELECT n, p, bits, CAST(floor(bits / n * ln(2)) AS BIGINT) AS hashes FROM m""",
    "bloom_bits": f"WITH {TOK}, {TERMS_CTE}, {_size_sql('words', FALSE_POSITIVES)}, {_build_sql()} SELECT word_idx, word FROM words",
    "bloom_probe": f"WITH {TOK}, {TERMS_CTE}, {LOG}, {ASKED}, {WANTED}, {_size_sql('words', FALSE_POSITIVES)}, {_build_sql()} {_probe_sql()}",
    "cascade_probe": f"WITH {TOK}, {TERMS_CTE}, {LOG}, {ASKED}, {WANTED}, "
    + ", ".join(f"{_size_sql(f'l{i}', p)}, {_build_sql(f'l{i}')}" for i, p in enumerate(_RATES))
    + " SELECT term, bool_and(maybe) AS maybe FROM ("
    + " UNION ALL ".join(_probe_sql(f"l{i}") for i in range(LEVELS))
    + ") GROUP BY term",
    "sharded_bloom_probe": f"WITH {TOK}, terms AS (SELECT term, CAST({h('-1', 'term')} % {SUB_SHARDS} AS INTEGER) AS bloom_shard FROM (SELECT DISTINCT term FROM tok)), {LOG}, {ASKED}, "
    + f"wanted AS (SELECT term, CAST({h('-1', 'term')} % {SUB_SHARDS} AS INTEGER) AS bloom_shard FROM (SELECT DISTINCT term FROM asked)), {_size_sql('words', FALSE_POSITIVES, f'count(*) // {SUB_SHARDS}')}, {_build_sql('words', 'bloom_shard')} {_probe_sql('words', 'bloom_shard')}",
    "ring_positions": f"WITH {RING} SELECT pos, shard_id FROM ring",
    "ring_lookup": f"WITH {TOK}, {TERMS_CTE}, {RING}, {LOOKUP} SELECT term, shard_id FROM placed",
    "shard_distribution": f"WITH {TOK}, {TERMS_CTE}, {DF}, {RING}, {LOOKUP}, {_N_TERMS} SELECT shard_id, n_terms FROM n_terms",
    "shard_balance": f"WITH {TOK}, {TERMS_CTE}, {DF}, {RING}, {LOOKUP}, {_N_TERMS} SELECT count(*) AS shards, round(avg(n_terms), 6) AS mean_terms, round(stddev_samp(n_terms), 6) AS stddev_terms FROM n_terms",
}
