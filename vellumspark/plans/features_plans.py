"""Queries over pattern features, signatures and vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import tokens, without_stop_words
from ..operators import access, features, pattern
from ..sources.storage import materialize
from ..sources.tables import documents, table
from .indexes import stored_patterns, stored_signatures
from .sql import COS, COUNTS, KEPT, LOG, QCOUNTS, VOCAB, chunks, equal_share, h, patterns, top

SHARDS = 100
#: Vectors whose ids this divides are the queries of the vector search, against all vectors.
QUERY_STEP = 20


def stop_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = without_stop_words(tokens(F.col("text")))
    return documents(spark, sf_dir).select("doc_id", F.size(ts).cast("bigint").alias("n_tokens"), F.md5(F.array_join(ts, " ")).alias("tokens_md5"))


def text_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = features.text_statistics(documents(spark, sf_dir), "doc_id")
    return s.select(F.col("key").alias("doc_id"), F.round("mean_length", 6).alias("mean_length"), F.round("richness", 6).alias("richness"))


def char_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = features.text_entropy(documents(spark, sf_dir), "doc_id")
    return e.select(F.col("key").alias("doc_id"), F.round("entropy", 6).alias("entropy"))


def vocab_topv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored_patterns(spark, sf_dir).vocabulary.select("term", "tf", "df", F.round("idf", 6).alias("idf"))


def tfidf_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = stored_patterns(spark, sf_dir).documents.select(F.col("key").alias("doc_id"), F.explode("weights").alias("term", "w"))
    return v.select("doc_id", "term", F.round("w", 6).alias("w"))


def pattern_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = stored_patterns(spark, sf_dir)
    return pattern.cosine_search(stored.documents, stored.queries)


def embedding_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    asked = vectors.filter(F.col("vec_id") % QUERY_STEP == 0).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    return pattern.vector_search(vectors, asked)


def signature_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored_signatures(spark, sf_dir)[0].select(F.col("key").alias("doc_id"), "c0", "c1", "c2", "c3")


def signature_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pattern.signature_search(*stored_signatures(spark, sf_dir))


def shard_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = stored_signatures(spark, sf_dir)[0]
    return s.select(F.col("key").alias("doc_id"), pattern.shard_of([F.col(f"c{i}") for i in range(4)], SHARDS).alias("shard_id"))


def trie_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many documents a walk reaches for each query."""
    return pattern.visits(*stored_signatures(spark, sf_dir))


def _access(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Written, so that joins know its size: the documents' features then stay where they lie if it is small."""
    return materialize(access.counts(table(spark, sf_dir, "events").select("user_id", "ts"), "user_id").select(F.col("user_id").alias("key"), "access_count"))


def shard_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard_assign(spark, sf_dir).join(_access(spark, sf_dir), F.col("doc_id") == F.col("key"))
    per_shard = placed.groupBy("shard_id").agg(F.sum("access_count").alias("accesses"))
    return pattern.rank_shards(per_shard, F.lit(0.5), SHARDS)


def search_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All shards, with the found texts."""
    stored = stored_patterns(spark, sf_dir)
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), F.col("text").alias("content"))
    return pattern.pattern_search(stored.documents, stored.queries, _access(spark, sf_dir), content=texts)


def search_pattern_ranked_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only the best shards by access, as an option."""
    stored = stored_patterns(spark, sf_dir)
    return pattern.pattern_search(stored.documents, stored.queries, _access(spark, sf_dir), shards=shard_rank(spark, sf_dir), shard_count=SHARDS)


QUERIES = {
    f.__name__: f
    for f in (stop_filtered, text_stats, char_entropy, vocab_topv, tfidf_vectors, pattern_cosine, embedding_topk, signature_bits, signature_match, shard_assign, trie_prune, shard_rank, search_pattern, search_pattern_ranked_shards)
}

_DP = f"{COUNTS}, {VOCAB}, {patterns('dp', 'counts')}"
_QP = f"{LOG}, {QCOUNTS}, {patterns('qp', 'qcounts')}"
_SIG = f"ds AS (SELECT key, {chunks('canonical', 'c')} FROM dp)"
_QSIG = f"qs AS (SELECT key AS qkey, {chunks('canonical', 'q')} FROM qp)"
_SHARD = f"placed AS (SELECT key AS doc_id, CAST({h('0', chr(39) * 2 + ' || c0 || chr(45) || c1 || chr(45) || c2 || chr(45) || c3')} % {SHARDS} AS INTEGER) AS shard_id FROM ds)"
_ACCESS = "acc AS (SELECT user_id AS key, count(*) AS access_count FROM events GROUP BY user_id)"
_COLS = "query_id, doc_id, score, rank"
_VISIT = "1 - bit_count(xor(q2, c2)) / 32 + ln(1 + {a}) / 10 >= 0.5 - 1e-12 AND 1 - bit_count(xor(q3, c3)) / 8 + ln(1 + {a}) / 10 >= 0.4 - 1e-12"


def _search_pattern_sql(more: str, ctes: str, joins: str, where: str = "") -> str:
    return f"""WITH {_DP}, {_QP}, {_SIG}, {_QSIG}, {COS}, {_ACCESS}{ctes},
j AS (SELECT query_id, doc_id, cos, {equal_share('q', 'c')} AS pm, coalesce(access_count, 0) AS access_count, q2, q3, c2, c3
  FROM cosines JOIN ds ON ds.key = doc_id JOIN qs ON qkey = query_id LEFT JOIN acc ON acc.key = doc_id),
s AS (SELECT query_id, doc_id, round(0.6 * cos + 0.3 * pm + 0.1 * ln(1 + access_count), 6) AS score, round(pm, 6) AS pattern_match, access_count FROM j WHERE round(cos, 6) >= 0.5 AND {_VISIT.format(a='access_count')} {where}),
t AS ({top('s', 10)}) SELECT query_id, doc_id, score, pattern_match, access_count, rank{', ' + more if more else ''} FROM t {joins}"""


SQL = {
    "stop_filtered": f"SELECT doc_id, CAST(len(ts) AS BIGINT) AS n_tokens, md5(array_to_string(ts, ' ')) AS tokens_md5 FROM (SELECT doc_id, {KEPT('text')} AS ts FROM documents)",
    "text_stats": f"""SELECT doc_id, CASE WHEN len(ts) > 0 THEN round(list_sum(list_transform(ts, lambda t: length(t))) / len(ts), 6) ELSE 0 END AS mean_length,
CASE WHEN len(ts) > 0 THEN round(len(list_distinct(ts)) / len(ts), 6) ELSE 0 END AS richness FROM (SELECT doc_id, {KEPT('text')} AS ts FROM documents)""",
    "char_entropy": f"""WITH {COUNTS}, ch AS (SELECT key, ch, sum(n) AS c FROM (SELECT key, n, unnest(string_split(token, '')) AS ch FROM counts) GROUP BY ALL),
p AS (SELECT key, c / sum(c) OVER (PARTITION BY key) AS p FROM ch) SELECT key AS doc_id, round(-sum(p * log2(p)), 6) + 0.0 AS entropy FROM p GROUP BY key""",
    "vocab_topv": f"WITH {VOCAB} SELECT term, tf, df, round(idf, 6) AS idf FROM vocab",
    "tfidf_vectors": f"WITH {_DP} SELECT key AS doc_id, term, round(w, 6) AS w FROM dp_w",
    "pattern_cosine": f"WITH {_DP}, {_QP}, {COS}, s AS (SELECT query_id, doc_id, round(cos, 6) AS score FROM cosines WHERE round(cos, 6) >= 0.5), t AS ({top('s', 10)}) SELECT {_COLS} FROM t",
    "embedding_topk": f"""WITH s AS (SELECT a.vec_id AS query_id, b.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score
FROM embeddings a CROSS JOIN embeddings b WHERE a.vec_id % {QUERY_STEP} = 0), t AS ({top('s', 10, 'vec_id')}) SELECT query_id, vec_id, score, rank FROM t""",
    "signature_bits": f"WITH {_DP}, {_SIG} SELECT key AS doc_id, c0, c1, c2, c3 FROM ds",
    "signature_match": f"WITH {_DP}, {_QP}, {_SIG}, {_QSIG}, s AS (SELECT qkey AS query_id, key AS doc_id, round({equal_share('q', 'c')}, 6) AS score FROM ds CROSS JOIN qs), t AS ({top('s', 10)}) SELECT {_COLS} FROM t",
    "shard_assign": f"WITH {_DP}, {_SIG}, {_SHARD} SELECT doc_id, shard_id FROM placed",
    "trie_prune": f"WITH {_DP}, {_QP}, {_SIG}, {_QSIG} SELECT qkey AS query_id, count(*) FILTER ({_VISIT.format(a=0)}) AS visited, count(*) AS documents FROM ds CROSS JOIN qs GROUP BY qkey",
    "shard_rank": f"""WITH {_DP}, {_SIG}, {_SHARD}, {_ACCESS}, s AS (SELECT shard_id, round(0.5 * ln(1 + sum(access_count)), 6) AS score FROM placed JOIN acc ON key = doc_id GROUP BY shard_id)
SELECT shard_id, score FROM s ORDER BY score DESC, shard_id DESC LIMIT {max(3, SHARDS // 10)}""",
    "search_pattern": _search_pattern_sql("content", ", doc AS (SELECT doc_id, text AS content FROM documents)", "JOIN doc USING (doc_id)"),
    "search_pattern_ranked_shards": _search_pattern_sql(
        "",
        f""", {_SHARD}, ranked AS (SELECT shard_id FROM (SELECT shard_id, round(0.5 * ln(1 + sum(access_count)), 6) AS score FROM placed JOIN acc ON key = doc_id GROUP BY shard_id) ORDER BY score DESC, shard_id DESC LIMIT {max(3, SHARDS // 10)})""",
        "",
        "AND doc_id IN (SELECT doc_id FROM placed JOIN ranked USING (shard_id))",
    ),
}
