"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat_format, fingerprint, language_id, license_scan, minhash, mixing, mpeg_audio, substring_dedup, url_filter

MINHASH_ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(generate_series(1, len(w) - 4), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
e AS (SELECT a AS u, b AS v FROM l UNION SELECT b, a FROM l),
reach(u, v) AS (SELECT u, v FROM e UNION SELECT reach.u, e.v FROM reach JOIN e ON reach.v = e.u),
m AS (SELECT u, min(v) AS v FROM reach GROUP BY u)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(m.v, d.doc_id)) AS component_id,
       d.doc_id = least(d.doc_id, coalesce(m.v, d.doc_id)) AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN m ON m.u = d.doc_id
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_chat_formatting": chat_format.query,
        "op2_minhash_near_dedup": minhash.query,
        "op3_language_id": language_id.query,
        "op4_byte_bpe": bpe.query,
        "op5_mpeg_audio": mpeg_audio.query,
        "op6_url_filter": url_filter.query,
        "op7_license_scan": license_scan.query,
        "op8_suffix_array_dedup": substring_dedup.query,
        "op9_document_fingerprint": fingerprint.query,
        "op10_source_mixing": mixing.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_chat_formatting": chat_format.ORACLE,
        "op2_minhash_near_dedup": MINHASH_ORACLE,
        "op6_url_filter": url_filter.ORACLE,
        "op7_license_scan": license_scan.oracle(),
        "op8_suffix_array_dedup": substring_dedup.ORACLE,
    }
