"""Generators and streaming twins as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import search
from ..sources import synth
from .sql import CAP, DF, h, top


def synth_uniform(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synth.uniform_documents(spark, 1000).select("doc_id", "content")


def synth_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synth.uniform_queries(spark, 1000)


def synth_zipf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synth.zipf_documents(spark, 1000).select("doc_id", "content")


def synth_zipf_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synth.zipf_queries(spark, 1000)


def synth_fruit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return synth.fruit_documents(spark)


def synth_fruit_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The small test corpus, searched with its own queries."""
    docs = synth.fruit_documents(spark).select(F.expr("cast(substring(content_id, 5) as bigint)").alias("doc_id"), F.col("content").alias("text"))
    return search.search_idf(docs, synth.fruit_queries(spark), k=10)


QUERIES = {f.__name__: f for f in (synth_uniform, synth_queries, synth_zipf, synth_zipf_queries, synth_fruit, synth_fruit_search)}


def _word_sql(seed: int, text: str) -> str:
    n = h(str(seed), text)
    return "concat(" + ", ".join(f"chr(CAST(97 + {n} // {26 ** (synth.WORD_LENGTH - 1 - i)} % 26 AS INTEGER))" for i in range(synth.WORD_LENGTH)) + ")"


def _pick_sql(seed: int, text: str) -> str:
    fruit = ", ".join(f"'{w}'" for w in synth.FRUIT)
    return f"[{fruit}][CAST(floor({len(synth.FRUIT)} * ({h(str(seed), text)} / 4294967296.0::DOUBLE)) AS BIGINT) + 1]"


_FRUIT = f"""fruit AS (SELECT i, j, {_pick_sql(42, "i || ':' || j")} AS w FROM (SELECT i, unnest(range(1, 21 + CAST(floor(80 * ({h('42', "i || ':n'")} / 4294967296.0::DOUBLE)) AS BIGINT))) AS j FROM range(1000) a(i)))"""

SQL = {
    "synth_uniform": f"""WITH w AS (SELECT DISTINCT i AS doc_id, {_word_sql(42, "i || ':' || j")} AS w FROM range(1000) a(i), range(1, 101) b(j))
SELECT doc_id, string_agg(w, ' ' ORDER BY w) AS content FROM w GROUP BY doc_id""",
    "synth_queries": f"""WITH w AS (SELECT i AS query_id, j, {_word_sql(43, "i || ':' || j")} AS w FROM range(1000) a(i), range(1, 4) b(j))
SELECT query_id, string_agg(w, ' ' ORDER BY j) AS query FROM w GROUP BY query_id""",
    "synth_fruit": f"WITH {_FRUIT} SELECT 'doc_' || i AS content_id, string_agg(w, ' ' ORDER BY j) AS content FROM fruit GROUP BY i",
    "synth_fruit_search": f"""WITH {_FRUIT}, tok AS (SELECT DISTINCT i AS doc_id, w AS term FROM fruit), {DF}, {CAP},
asked AS (SELECT DISTINCT i AS query_id, {_pick_sql(43, "i || ':' || j")} AS term FROM (SELECT i, unnest(range(1, 3 + CAST(floor(3 * ({h('43', "i || ':n'")} / 4294967296.0::DOUBLE)) AS BIGINT))) AS j FROM range(100) a(i))),
idf AS (SELECT query_id, doc_id, round(sum(1.0::DOUBLE / greatest(1, df)), 6) AS score FROM asked JOIN df USING (term) JOIN cap USING (term) GROUP BY ALL),
t AS ({top('idf', 10)}) SELECT query_id, doc_id, score, rank FROM t""",
}
