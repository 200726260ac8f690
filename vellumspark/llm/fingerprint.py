"""Document fingerprints: canonical exact digests.

A text's canonical form is NFKC, case-folded, NFKC again, with white space runs folded to one space and trimmed. Its
fingerprint is the 128-bit XXH3 of that form. Documents with equal fingerprints are grouped and their canonical forms
compared byte by byte (as one Zstandard level and library write them, which is one-to-one).

Defined cases: a null text is empty; repeated rows are kept and fall into one group; a null doc_id sorts first; an empty
table gives an empty result; lone surrogates cannot occur in Spark strings; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import columns, materialize, shuffle_partitions, table

ZSTD_LEVEL = 3
#: doc_ids drawn for each range when ids are cut into ranges.
SAMPLE = 20
#: Rows of an Arrow batch that leave a worker at once.
OUT_ROWS = 512


def canonical(text: str | None) -> str:
    text = text or ""
    if text.isascii():
        return " ".join(text.lower().split())
    return " ".join(unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold()).split())


def fingerprint(text: str | None) -> str:
    return xxhash.xxh3_128_hexdigest(canonical(text).encode("utf-8", "surrogatepass"))


def edited(text: str, following: str) -> str:
    """The last floor(n / 2) code points replaced by as many (or all) first ones of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def likeness(a: str, b: str) -> float:
    """1.0 for equal canonical forms, else 0.0: equal fingerprints are confirmed on the bytes."""
    return 1.0 if fingerprint(a) == fingerprint(b) and canonical(a).encode() == canonical(b).encode() else 0.0


def _digest_batches(batches: Iterator[pa.RecordBatch], digest: Callable[[bytes], str]) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(level=ZSTD_LEVEL).compress
    for batch in batches:
        for at in range(0, batch.num_rows, OUT_ROWS):
            part = batch.slice(at, OUT_ROWS)
            forms = [canonical(t).encode() for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([digest(f) for f in forms], pa.string()), pa.array([pack(f) for f in forms], pa.binary())],
                names=["doc_id", "fingerprint", "form"],
            )


def exact_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", digest: Callable[[bytes], str] = xxhash.xxh3_128_hexdigest) -> DataFrame:
    """``doc_id, fingerprint, group_id`` of each document; the group is its least doc_id.

    Digest and form are grouped together and pre-aggregated before the shuffle, so a form that a third of all documents
    share leaves each task once. Groups of one document are dropped; the documents then meet the groups' small table in a
    join whose hot digests Spark can split.
    """
    rows = columns(docs, doc_id=doc_id, text=text)
    digests = rows.mapInArrow(lambda batches: _digest_batches(batches, digest), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, fingerprint string, form binary")
    light = materialize(digests.select("doc_id", "fingerprint"))
    groups = digests.groupBy("fingerprint", "form").agg(F.min("doc_id").alias("group_id"), F.count(F.lit(1)).alias("n"))
    # Different forms under one digest are told apart by their bytes; without any, the digest alone finds the group.
    groups = materialize(groups.select("fingerprint", "group_id", "n"))
    clashing = groups.groupBy("fingerprint").count().filter("count > 1").select("fingerprint")
    if clashing.head(1):
        forms = digests.join(clashing, "fingerprint", "left_semi")
        told = forms.join(forms.groupBy("fingerprint", "form").agg(F.min("doc_id").alias("group_id")), ["fingerprint", "form"])
        told = told.select("doc_id", "fingerprint", "group_id")
        rest = light.join(clashing, "fingerprint", "left_anti")
    else:
        told, rest = None, light
    shared = groups.filter("n > 1").select("fingerprint", "group_id")
    found = rest.join(shared.hint("merge"), "fingerprint", "left").select("doc_id", "fingerprint", F.coalesce("group_id", "doc_id").alias("group_id"))
    return found if told is None else found.unionByName(told)


def _pack_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(level=ZSTD_LEVEL).compress
    for batch in batches:
        for at in range(0, batch.num_rows, OUT_ROWS):
            part = batch.slice(at, OUT_ROWS)
            packed = pa.array([pack((t or "").encode("utf-8", "surrogatepass")) for t in part.column(1).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column(0), packed], names=["doc_id", "packed"])


def _compare(doc_id, text: str, following: str) -> tuple:
    form, next_form, new = canonical(text).encode(), canonical(following).encode(), edited(text, following)
    new_form = canonical(new).encode()
    a, b, c = (xxhash.xxh3_128_hexdigest(f) for f in (form, new_form, next_form))
    return (doc_id, len(text), hashlib.sha256(new.encode()).hexdigest(), a, b, float(a == b and form == new_form), float(a == c and form == next_form))


_PAIR_NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]


def _pair_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by range, ahead, doc_id, text: each meets its follower; only two texts are held at a time."""
    unpack = zstandard.ZstdDecompressor().decompress
    kept, out, id_type = None, [], pa.int64()

    def flush():
        nonlocal out
        done, out = out, []
        cols = list(zip(*done, strict=True))
        types = [id_type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=_PAIR_NAMES)

    for batch in batches:
        id_type = batch.schema.field("doc_id").type
        ranges, ahead, ids = (batch.column(n).to_pylist() for n in ("range", "ahead", "doc_id"))
        packed = batch.column("packed")
        for k in range(batch.num_rows):
            if ahead[k] and (kept is None or kept[0] != ranges[k]):
                continue  # a further copy of the range's follower, or a range without rows
            text = unpack(packed[k].as_py()).decode("utf-8", "surrogatepass")
            if kept is not None and kept[0] == ranges[k]:
                out.append(_compare(kept[1], kept[2], text))
            kept = None if ahead[k] else (ranges[k], ids[k], text)
            if len(out) >= OUT_ROWS:
                yield flush()
    if out:
        yield flush()


def _range_starts(rows: DataFrame, n: int, total: int, least) -> list:
    """Up to n - 1 doc_ids above the least one that cut the ids into even ranges."""
    share = min(1.0, SAMPLE * n / max(1, total))
    ids = rows.filter(F.col("doc_id").isNotNull() & (F.col("doc_id") != F.lit(least)) & (F.pmod(F.xxhash64("doc_id"), F.lit(2**40)) < share * 2**40))
    drawn = [r[0] for r in ids.select("doc_id").distinct().orderBy("doc_id").collect()] if total else []
    return [x for k, x in enumerate(drawn) if k * n // len(drawn) != (k - 1) * n // len(drawn)][1 if len(drawn) >= n else 0 :]


def against_next(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", ranges: int | None = None) -> DataFrame:
    """Each document against its edited text and the next document by doc_id (after the last: the first).

    doc_ids, of any type that Spark orders, are cut into ranges at doc_ids of a hashed sample; the documents that start a range
    go to the end of the range before as well, so each document meets its follower inside its range and no task sees the
    whole order. A driver list holds about SAMPLE ids a range.
    """
    rows = columns(docs, doc_id=doc_id, text=text)
    n = ranges or 2 * shuffle_partitions(docs.sparkSession)
    id_type = rows.schema["doc_id"].dataType.simpleString()
    cuts = rows.agg(F.min("doc_id").alias("least"), F.count("doc_id").alias("n"), F.count(F.when(F.col("doc_id").isNull(), 1)).alias("nulls")).first()
    # The first range starts at the least id, or at null.
    starts = _range_starts(rows, n, cuts["n"], cuts["least"])
    bounds = F.array(*[F.lit(x) for x in starts]).cast(f"array<{id_type}>")
    first = F.col("doc_id").isNull() if cuts["nulls"] else (F.col("doc_id") == F.lit(cuts["least"]))
    at = F.coalesce(F.size(F.filter(bounds, lambda b: b <= F.col("doc_id"))), F.lit(0))
    at = F.when(F.col("doc_id").isNull(), 0).otherwise(at)
    opens = F.when(first, F.lit(len(starts))).when(F.array_contains(bounds, F.coalesce("doc_id", F.lit(cuts["least"]).cast(id_type))) & F.col("doc_id").isNotNull(), at - 1)
    packed = rows.mapInArrow(_pack_batches, f"doc_id {id_type}, packed binary")
    placed = packed.withColumn("place", F.array_compact(F.array(F.struct(at.alias("range"), F.lit(False).alias("ahead")), F.when(opens.isNotNull(), F.struct(opens.alias("range"), F.lit(True).alias("ahead"))))))
    placed = placed.select(F.explode("place").alias("p"), "doc_id", "packed").select("p.range", "p.ahead", "doc_id", "packed")
    dealt = placed.repartition(shuffle_partitions(docs.sparkSession), "range").sortWithinPartitions("range", "ahead", "doc_id", "packed")
    return dealt.mapInArrow(_pair_batches, f"doc_id {id_type}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    # Rows of equal doc_id and fingerprint have one group; nulls meet nulls.
    groups = exact_groups(docs).groupBy(F.col("doc_id").alias("of"), F.col("fingerprint").alias("form")).agg(F.min("group_id").alias("group_id"))
    groups = materialize(groups)
    pairs = against_next(docs)
    return pairs.join(groups, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("fingerprint") == F.col("form"))).drop("of", "form")
