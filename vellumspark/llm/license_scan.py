"""Licence scan by canonical digest, in DataFrame functions alone.

A text is normalised (case, copyright and rights lines, equivalent spellings, punctuation, white space; letters and digits of all
scripts stay) and its SHA-256 is joined with the digests of known licence texts, normalised the same way. Only an entire text
matches; a licence inside a longer text does not.

Defined cases: a null or wordless text has the digest of the empty text and matches nothing; repeated rows are judged alike
and kept; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import columns, table
from .licenses import KNOWN

#: Pairs of equivalent spellings, applied in order on lower-case text.
SPELLINGS = [
    (r"\blicences?\b", "license"),
    (r"\blicenses\b", "license"),
    (r"\blicenced\b", "licensed"),
    (r"\bsub-?licen[cs]e\b", "sublicense"),
    (r"\bnon-?commercial\b", "noncommercial"),
    (r"\bwhilst\b", "while"),
    (r"\bmerchantibility\b", "merchantability"),
    (r"\borganisation\b", "organization"),
    (r"\bauthorised\b", "authorized"),
    (r"\bfulfil\b", "fulfill"),
    (r"\bcopyright holders\b", "copyright holder"),
    (r"\bcopyright owners?\b", "copyright holder"),
    (r"https:", "http:"),
]
#: A line that only says who holds the copyright, and one that reserves rights.
COPYRIGHT_LINE = r"(?m)^[^a-z0-9\n]*(?:copyright\b|\(c\)|©)[^\n]*(?:\d{4}|©|\(c\)|<year>|\[year\])[^\n]*$"
#: A line that names the holder alone: the word and capitalised names, read before case is folded.
NAME_LINE = r"(?m)^[^A-Za-z0-9\n]*Copyright:?[ \t]+(?:by[ \t]+)?[A-Z][A-Za-z.'&-]*(?:,?[ \t]+[A-Z][A-Za-z.'&-]*){0,7}[^A-Za-z0-9\n]*$"
RIGHTS_LINE = r"(?m)^[^a-z0-9\n]*all rights reserved[^a-z0-9\n]*$"


def canonical(text: Column) -> Column:
    """The normal form of a licence text: its lower-case words, joined by one space."""
    c = F.regexp_replace(F.coalesce(text, F.lit("")), "\r\n?", "\n")
    c = F.lower(F.when(c.contains("Copyright"), F.regexp_replace(c, NAME_LINE, "")).otherwise(c))
    # The costly patterns run only where a cheap search says that they can match.
    c = F.when(c.contains("copyright") | c.contains("(c)") | c.contains("©"), F.regexp_replace(c, COPYRIGHT_LINE, "")).otherwise(c)
    c = F.when(c.contains("rights reserved"), F.regexp_replace(c, RIGHTS_LINE, "")).otherwise(c)
    for pattern, to in SPELLINGS:
        c = F.regexp_replace(c, pattern, to)
    return F.trim(F.regexp_replace(c, r"[^\p{L}\p{N}]+", " "))


def known_digests(spark: SparkSession, known: dict[str, str] = KNOWN) -> DataFrame:
    """``license_id, license_sha256`` of the known texts; of equal texts the least id stays."""
    rows = spark.createDataFrame(sorted(known.items()), "license_id string, body string")
    digests = rows.select("license_id", F.sha2(canonical(F.col("body")), 256).alias("license_sha256"))
    return digests.groupBy("license_sha256").agg(F.min("license_id").alias("license_id"))


def scan(docs: DataFrame, known: DataFrame | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_words, canonical_sha256, license_id`` of each document.

    The table of known licences has fixed size when it is the module's own, and is then broadcast; a table that is handed
    in is joined as Spark sees fit.
    """
    rows = columns(docs, doc_id=doc_id, text=text).select("doc_id", canonical(F.col("text")).alias("c"))
    words = F.when(F.col("c") == "", 0).otherwise(F.length("c") - F.length(F.translate("c", " ", "")) + 1).cast("long")
    rows = rows.select("doc_id", words.alias("n_words"), F.sha2("c", 256).alias("canonical_sha256"))
    digests = F.broadcast(known_digests(docs.sparkSession)) if known is None else columns(known, license_sha256="license_sha256", license_id="license_id")
    hit = (F.col("canonical_sha256") == F.col("license_sha256")) & (F.col("n_words") > 0)
    return rows.join(digests, hit, "left").select("doc_id", "n_words", "canonical_sha256", "license_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"))


def _sql_canonical(text: str) -> str:
    names = NAME_LINE.replace("'", "''")
    sql = f"lower(regexp_replace(regexp_replace(coalesce({text}, ''), '\\r\\n?', chr(10), 'g'), '{names}', '', 'g'))"
    for pattern in (COPYRIGHT_LINE, RIGHTS_LINE):
        sql = f"regexp_replace({sql}, '{pattern}', '', 'g')"
    for pattern, to in SPELLINGS:
        sql = f"regexp_replace({sql}, '{pattern}', '{to}', 'g')"
    return f"trim(regexp_replace({sql}, '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"


def oracle() -> str:
    known = ", ".join("('{}', '{}')".format(k, v.replace("'", "''")) for k, v in sorted(KNOWN.items()))
    return f"""
WITH k AS (SELECT sha256({_sql_canonical("body")}) AS d, min(id) AS license_id FROM (VALUES {known}) t(id, body) GROUP BY 1),
c AS (SELECT doc_id, {_sql_canonical("text")} AS c FROM documents),
n AS (SELECT doc_id, sha256(c) AS canonical_sha256, CAST(CASE WHEN c = '' THEN 0 ELSE length(c) - length(replace(c, ' ', '')) + 1 END AS BIGINT) AS n_words FROM c)
SELECT doc_id, n_words, canonical_sha256, license_id FROM n LEFT JOIN k ON canonical_sha256 = d AND n_words > 0
"""
