"""Common table expressions of the SQL twins."""

from __future__ import annotations

from ..functions.text import LONG_WORD, STOP_WORDS, WORD_OR_MARK


def TERMS(x: str) -> str:  # noqa: N802
    return rf"list_filter(string_split_regex(lower(coalesce({x}, '')), '\s+'), lambda t: t <> '')"


def WORDS(x: str) -> str:  # noqa: N802
    return f"regexp_extract_all(lower(coalesce({x}, '')), '{WORD_OR_MARK}')"


def KEPT(x: str) -> str:  # noqa: N802
    stop = ", ".join("'" + w.replace("'", "''") + "'" for w in STOP_WORDS)
    return f"list_filter({WORDS(x)}, lambda t: t NOT IN ({stop}))"


def LONG(x: str) -> str:  # noqa: N802
    return f"regexp_extract_all(lower(coalesce({x}, '')), '{LONG_WORD}')"



TOK = f"tok AS (SELECT DISTINCT doc_id, unnest({TERMS('text')}) AS term FROM documents)"
DF = "df AS (SELECT term, count(*) AS df FROM tok GROUP BY term)"
CAP = "cap AS (SELECT term, doc_id FROM (SELECT term, doc_id, row_number() OVER (PARTITION BY term ORDER BY doc_id) AS rn FROM tok) WHERE rn <= 100)"
LOG = f"log AS (SELECT item_id AS query_id, array_to_string(({TERMS('text')})[1:3], ' ') AS query FROM benchmark)"
ASKED = f"asked AS (SELECT DISTINCT query_id, unnest({TERMS('query')}) AS term FROM log)"


def top(scored: str, k: int, tie: str = "doc_id") -> str:
    return f"SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, {tie}) AS rank FROM {scored} QUALIFY rank <= {k}"


def h(seed: str, text: str) -> str:
    return f"CAST('0x' || substr(md5(CAST({seed} AS VARCHAR) || ':' || {text}), 1, 8) AS BIGINT)"


COUNTS = f"counts AS (SELECT doc_id AS key, token, count(*) AS n FROM (SELECT doc_id, unnest({KEPT('text')}) AS token FROM documents) GROUP BY ALL)"
QCOUNTS = f"qcounts AS (SELECT query_id AS key, token, count(*) AS n FROM (SELECT query_id, unnest({KEPT('query')}) AS token FROM log) GROUP BY ALL)"
VOCAB = f"""perdoc AS (SELECT doc_id, term, count(*) AS n FROM (SELECT doc_id, unnest({LONG('text')}) AS term FROM documents) GROUP BY ALL),
vocab AS (SELECT term, CAST(sum(n) AS BIGINT) AS tf, count(*) AS df, ln((1 + (SELECT count(*) FROM documents)) / (1 + count(*))) + 1 AS idf
  FROM perdoc GROUP BY term ORDER BY sum(n) DESC, term LIMIT 1000)"""


def patterns(name: str, counts: str) -> str:
    """The CTEs of ``patterns``: {name}_w (key, term, w) and {name} (key, ml, ri, en, norm, canonical)."""
    return f"""{name}_v AS (SELECT key, term, n * idf AS v FROM {counts} JOIN vocab ON token = term),
{name}_w AS (SELECT key, term, v / sqrt(sum(v * v) OVER (PARTITION BY key)) AS w FROM {name}_v),
{name}_c AS (SELECT key, ch, sum(n) AS c FROM (SELECT key, n, unnest(string_split(token, '')) AS ch FROM {counts}) GROUP BY ALL),
{name}_e AS (SELECT key, log2(sum(c)) - sum(c * log2(c)) / sum(c) AS en FROM {name}_c GROUP BY key),
{name}_s AS (SELECT key, sum(n * length(token)) / sum(n) AS ml, count(*) / sum(n) AS ri,
  md5(string_agg(token || ':' || n, ' ' ORDER BY encode(token || ':' || n))) AS canonical FROM {counts} GROUP BY key),
{name} AS (SELECT s.key, ml, ri, en, canonical, sqrt(CASE WHEN s.key IN (SELECT key FROM {name}_v) THEN 1 ELSE 0 END + ml * ml + ri * ri + en * en) AS norm
  FROM {name}_s s JOIN {name}_e e ON s.key = e.key)"""


COS = """dots AS (SELECT a.key AS q, b.key AS d, sum(a.w * b.w) AS dot FROM qp_w a JOIN dp_w b ON a.term = b.term GROUP BY ALL),
cosines AS (SELECT qp.key AS query_id, dp.key AS doc_id, qp.canonical AS qc, dp.canonical AS dc,
  (coalesce(dot, 0) + qp.ml * dp.ml + qp.ri * dp.ri + qp.en * dp.en) / nullif(qp.norm * dp.norm, 0) AS cos
  FROM qp CROSS JOIN dp LEFT JOIN dots ON q = qp.key AND d = dp.key)"""


def chunks(canonical: str, prefix: str = "c") -> str:
    """Four expressions: the signature's words."""
    out = []
    for k, start in enumerate(range(0, 100, 32)):
        stop = min(100, start + 32)
        terms = " + ".join(f"(CASE WHEN {h(str(i), canonical)} >= 2147483648 THEN 1::BIGINT << {stop - 1 - i} ELSE 0 END)" for i in range(start, stop))
        out.append(f"{terms} AS {prefix}{k}")
    return ", ".join(out)


def equal_share(a: str, b: str) -> str:
    return "(1 - (" + " + ".join(f"bit_count(xor({a}{k}, {b}{k}))" for k in range(4)) + ") / 104)"
