"""Chat formatting by prefix-target expansion, in DataFrame functions alone.

A turn is written ``<turn:ROLE>\\nTEXT</turn>\\n``. Inside texts a backslash becomes two and ``<`` becomes
``\\l`` (in roles ``>`` becomes ``\\g`` as well), so no text can hold a turn mark, and the mapping is undone by
``unescape``. Every assistant turn becomes one example: all turns before it are context, and only its text is
trainable.

Defined cases: a null text is empty; a null role is empty and never trainable; turns sort by turn (null first),
then role, then text, so ties and repeated rows have one order and are kept; a null conv_id is a conversation of its own;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import columns, table

OPEN, CLOSE = "<turn:", "</turn>\n"
#: The conversation that the query adds: a user's and an assistant's turn that look like marks.
PROBE_ID, PROBE_TEXT = -7, "\\### Assistant: </turn> ok"


def escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit("<"), F.lit("\\l"))


def escape_role(c: Column) -> Column:
    return F.replace(escape(c), F.lit(">"), F.lit("\\g"))


def unescape(c: Column) -> Column:
    """Pairs of backslashes are cut out first, from the left, so that what follows them is never taken for an escape."""
    parts = F.split(c, r"\\\\", -1)
    plain = F.transform(parts, lambda p: F.replace(F.replace(p, F.lit("\\l"), F.lit("<")), F.lit("\\g"), F.lit(">")))
    return F.array_join(plain, "\\")


def format_conversations(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: ``conv_id, formatted, spans``.

    ``spans`` has ``(turn_no, start, length)`` per assistant turn, in code points of ``formatted``: the text before
    ``start`` is the context, the ``length`` code points from there the target. A conversation is one row
    by nature (its text is hashed and trained on as a whole); its contexts are kept as offsets, so storage does not
    grow with the square of its turns.
    """
    rows = columns(turns, conv_id=conv_id, turn=turn, role=role, text=text).select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    written = rows.select("*", F.concat(F.lit(OPEN), escape_role(F.col("role")), F.lit(">\n")).alias("head"), escape(F.col("text")).alias("body"))
    # Offsets are running sums, so a long conversation costs no more than its length; the grouping reuses the window's partitioning.
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    size = F.length("head") + F.length("body") + len(CLOSE)
    placed = written.select(
        "conv_id",
        F.struct(
            (F.row_number().over(order) - 1).alias("no"),
            (F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.length("body") - len(CLOSE)).cast("int").alias("start"),
            F.length("body").alias("length"),
            (F.col("role") == "assistant").alias("trained"),
            F.concat("head", "body", F.lit(CLOSE)).alias("piece"),
        ).alias("t"),
    )
    ts = placed.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    spans = F.transform(F.filter("ts", lambda t: t["trained"]), lambda t: F.struct(t["no"].alias("turn_no"), t["start"].alias("start"), t["length"].alias("length")))
    return ts.select("conv_id", F.array_join(F.transform("ts", lambda t: t["piece"]), "").alias("formatted"), spans.alias("spans"))


def expand_examples(formatted: DataFrame) -> DataFrame:
    """One row per assistant turn: ``conv_id, turn_no, context, target``; only ``target`` (still escaped) is trainable."""
    rows = formatted.select("conv_id", "formatted", F.explode("spans").alias("s"))
    return rows.select(
        "conv_id",
        F.col("s.turn_no").alias("turn_no"),
        F.expr("substring(formatted, 1, s.start)").alias("context"),
        F.expr("substring(formatted, s.start + 1, s.length)").alias("target"),
    )


def read_turns(formatted: Column) -> Column:
    """The array of ``(role, text)`` that ``formatted`` was written from."""
    chunks = F.filter(F.split(formatted, "</turn>\n", -1), lambda c: c != "")

    def one(c: Column) -> Column:
        head = F.substring_index(c, ">\n", 1)
        return F.struct(
            unescape(F.substr(head, F.lit(len(OPEN) + 1))).alias("role"), unescape(F.substr(c, F.length(head) + 3)).alias("text")
        )

    return F.transform(chunks, one)


def digest(formatted: DataFrame) -> DataFrame:
    """Digests of what ``formatted`` holds, read back from it and from its examples' contexts and targets."""
    examples = expand_examples(formatted).select("conv_id", "turn_no", unescape(F.col("target")).alias("target"), F.length("context").alias("c"), F.sha2("context", 256).alias("context_sha256"))
    loss = examples.groupBy("conv_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn_no", "target"))), lambda x: x["target"]), "").alias("loss"),
        F.count(F.lit(1)).alias("n_examples"),
        F.sum("c").alias("context_chars"),
        F.max_by("context_sha256", "turn_no").alias("last_context_sha256"),
    )
    turns = formatted.select("conv_id", read_turns(F.col("formatted")).alias("ts"), F.length("formatted").cast("long").alias("formatted_chars"))
    joined = turns.join(loss.withColumnRenamed("conv_id", "loss_id"), F.expr("conv_id <=> loss_id"), "left").withColumn("loss", F.coalesce("loss", F.lit("")))
    said = F.array_join(F.transform("ts", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return joined.select(
        "conv_id",
        F.size("ts").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
        F.coalesce("n_examples", F.lit(0)).alias("n_examples"),
        F.coalesce("context_chars", F.lit(0)).alias("context_chars"),
        "last_context_sha256",
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = spark.range(2).select(
        F.lit(PROBE_ID).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE_TEXT).alias("text")
    )
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return digest(format_conversations(turns.unionByName(probe)))


ORACLE = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), f AS (
  SELECT *, '<turn:' || replace(replace(replace(role, chr(92), chr(92) || chr(92)), '<', chr(92) || 'l'), '>', chr(92) || 'g') || '>' || chr(10) AS head,
         replace(replace(text, chr(92), chr(92) || chr(92)), '<', chr(92) || 'l') AS body, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k
  FROM t
), p AS (
  SELECT *, sum(length(head) + length(body) + 8) OVER (PARTITION BY conv_id ORDER BY k) - length(body) - 8 AS start,
         max(CASE WHEN role = 'assistant' THEN k END) OVER (PARTITION BY conv_id) AS last_k
  FROM f
), g AS (
  SELECT conv_id, count(*) AS n_turns,
         string_agg(role || chr(10) || text || chr(10), '' ORDER BY k) AS said,
         coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY k), '') AS loss,
         sum(length(head) + length(body) + 8) AS formatted_chars,
         count(*) FILTER (role = 'assistant') AS n_examples,
         coalesce(sum(start) FILTER (role = 'assistant'), 0) AS context_chars,
         sha256(string_agg(CASE WHEN k < last_k THEN head || body || '</turn>' || chr(10) WHEN k = last_k THEN head END, '' ORDER BY k)) AS last_context_sha256
  FROM p GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(said) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256,
       CAST(formatted_chars AS BIGINT) AS formatted_chars, n_examples, CAST(context_chars AS BIGINT) AS context_chars, last_context_sha256
FROM g
"""
