"""Byte-level BPE encoding and decoding over overlapping chunks.

Long texts are cut into chunks that overlap; each chunk is pre-tokenised by itself, in parallel. Pre-tokenisation from a
boundary depends only on the text after it, so where a chunk and the one before share a boundary inside the
overlap, away from the cut, both agree from there on: the chunks are stitched at the first such place that does not follow white space. The pre-tokens between
stitches are then encoded, each by merging the lowest rank first. Decoding concatenates the raw bytes of the ids.

Defined cases: a null text is empty and has no ids; a chunk without a shared boundary (one pre-token longer than the
overlap) is joined to the one before and pre-tokenised again from the last good boundary; repeated rows are kept; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import columns, materialize, shuffle_partitions, table

#: Code points of a chunk without its overlap, and of the overlap with the next chunk.
CHUNK, OVERLAP = 16_384, 1_024
#: Boundaries this near to a chunk's end may be the cut's doing: the last match, and white space before it.
UNSURE = 3
#: Pre-tokens that a worker keeps encoded, in each of two tables: when the newer is full it becomes the older, from which those in use return.
CACHE = 150_000
#: Pre-tokens of up to so many bytes are merged by the tokenizer library's own merge of one piece.
SHORT = 32
OUT_ROWS = 256


@lru_cache(maxsize=4)
def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one pre-token: of all neighbouring pairs the one of lowest rank merges, the leftmost first.

    A heap of pairs and links between parts keep it at n log n, so one pre-token of a megabyte is no trap.
    """
    if piece in ranks:
        return [ranks[piece]]
    n = len(piece)
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))
    live = [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        if not live[i] or end[i] >= n or end[end[i]] != stop:
            continue
        j = end[i]
        live[j], end[i] = False, stop
        if stop < n:
            before[stop] = i
            if (r := ranks.get(piece[i : end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        if (h := before[i]) >= 0 and (r := ranks.get(piece[h:stop])) is not None:
            heapq.heappush(heap, (r, h, stop))
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : end[i]]])
        i = end[i]
    return ids


_SPACE = regex.compile(r"\s")


def seams(text: str, cuts: list[int]) -> list[int]:
    """Those of the boundaries at which a piece may end: white space before one could split otherwise without what follows."""
    return [b for b in cuts if b and not _SPACE.match(text, b - 1)]


def boundaries(text: str, find) -> list[int]:
    """Where the pre-tokens of ``text`` start, and its end."""
    return [m.start() for m in find(text)] + [len(text)]


def matches(text: str, pattern: regex.Pattern) -> tuple[list[int], bytes | None]:
    """``boundaries`` and the lengths of the pre-tokens, which are None where the pattern leaves gaps between them."""
    sizes = list(map(len, pattern.findall(text)))
    ends = list(accumulate(sizes))
    if not text or (ends and ends[-1] == len(text)):
        return [0, *ends], np.array(sizes, "<u4").tobytes()
    return boundaries(text, pattern.finditer), None


def stitch(chunks: Iterable[tuple[int, str]], find) -> Iterator[str]:
    """The text of ``chunks`` in pieces that begin and end at true boundaries.

    ``chunks`` are (start, text) in order; each overlaps the next by no more than the distance of their starts.
    """
    carried, base, cuts = "", 0, []
    for start, text in chunks:
        if not cuts:
            carried, base, cuts = text, start, [base + b for b in boundaries(text, find)]
            continue
        own = [start + b for b in boundaries(text, find)]
        # The last matches before the cut are unsure; so is the end itself.
        safe = {base + b for b in seams(carried, [c - base for c in cuts[:-UNSURE]])}
        common = min(safe.intersection(own[:-UNSURE]), default=None)
        if common is None:
            carried = carried[: start - base] + text
            cuts = [base + b for b in boundaries(carried, find)]
            continue
        yield carried[: common - base]
        carried, base = text[common - start :], common
        cuts = [b for b in own if b >= common]
    if cuts:
        yield carried


class Known(dict):
    """The ids of pre-tokens; those seen before come from a bounded table, the others are merged when they are asked for."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.older = ranks, {}
        # Merging one short pre-token is the same work as ``merge``, compiled; long ones keep to ``merge``, whose cost is bounded.
        self.merge_short = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})._encode_single_piece

    def __missing__(self, piece: str) -> list[int]:
        if len(self) >= CACHE:
            self.older = dict(self)
            self.clear()
        ids = self.older.get(piece)
        if ids is None:
            raw = piece.encode("utf-8", "surrogatepass")
            ids = self.merge_short(raw) if len(raw) <= SHORT else merge(raw, self.ranks)
        if len(piece) <= 64:
            self[piece] = ids
        return ids


class Coder:
    """Encodes and decodes by one rank table."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.find = ranks, regex.compile(pattern).finditer
        self.findall = regex.compile(pattern).findall
        self.raw = {v: k for k, v in ranks.items()}
        self.decimal = {v: str(v) for v in self.raw}
        self.known = Known(ranks, pattern)

    def encode_piece(self, text: str) -> list[int]:
        """The ids of a text that begins and ends at true boundaries."""
        return self.encode_parts(self.findall(text))

    def encode_parts(self, parts: Iterable[str]) -> list[int]:
        """The ids of pre-tokens."""
        return list(chain.from_iterable(map(self.known.__getitem__, parts)))

    def encode_range(self, text: str, sizes: bytes | None, start: int, stop: int) -> list[int]:
        """The ids of ``text[start:stop]``, whose ends are boundaries; with the sizes of the pre-tokens of ``text`` none is searched for again."""
        if sizes is None:
            return self.encode_piece(text[start:stop])
        ends = np.cumsum(np.frombuffer(sizes, "<u4"))
        inside = ends[np.searchsorted(ends, start, "right") : np.searchsorted(ends, stop, "right")].tolist()
        return self.encode_parts([text[i:j] for i, j in zip([start, *inside[:-1]], inside, strict=True)] if inside else [])

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.raw.__getitem__, ids))


_coders: dict[tuple[str, str], Coder] = {}


def _coder(path: str, pattern: str) -> Coder:
    if (path, pattern) not in _coders:
        _coders[path, pattern] = Coder(load_ranks(path), pattern)
    return _coders[path, pattern]


_RESULT = ["n_tokens", "ids_sha256", "decoded_sha256"]


def _summary(ids: list[int], coder: Coder) -> tuple[int, str, str]:
    return len(ids), hashlib.sha256(" ".join(map(coder.decimal.__getitem__, ids)).encode()).hexdigest(), hashlib.sha256(coder.decode(ids)).hexdigest()


def _encode_whole(path: str, pattern: str, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, OUT_ROWS):
                part = batch.slice(at, OUT_ROWS)
                rows, kept = [], []
                for text in part.column(1).to_pylist():
                    ids = coder.encode_piece(text or "")
                    rows.append(_summary(ids, coder))
                    kept.append(ids)
                cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.string()), strict=True)]
                names = ["doc_id", *_RESULT]
                if keep_ids:
                    cols.append(pa.array(kept, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays([part.column(0), *cols], names=names)

    return run


def _pretokenise(pattern: str):
    """Chunks to chunks with the sizes of their pre-tokens and their boundaries near both ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = regex.compile(pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 16):
                part = batch.slice(at, 16)
                heads, tails, sizes = [], [], []
                for start, text, last in zip(part.column("start").to_pylist(), part.column("chunk").to_pylist(), part.column("last").to_pylist(), strict=True):
                    found, lengths = matches(text, compiled)
                    sizes.append(lengths)
                    sure = found if last else found[:-UNSURE]
                    heads.append([start + b for b in sure[: bisect_left(sure, OVERLAP)]])
                    tails.append([start + b for b in seams(text, sure[bisect_left(sure, CHUNK) :])])
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array(heads, pa.list_(pa.int64())), pa.array(tails, pa.list_(pa.int64())), pa.array(sizes, pa.binary())], names=[*part.schema.names, "head", "tail", "sizes"]
                )

    return run


def _encode_span(path: str, pattern: str):
    """The pre-tokens of chunks between two stitches to their ids, as 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 16):
                part = batch.slice(at, 16)
                spans = zip(*(part.column(n).to_pylist() for n in ("chunk", "sizes", "lo", "hi")), strict=True)
                ids = [np.array(coder.encode_range(*span), "<i4").tobytes() for span in spans]
                yield pa.RecordBatch.from_arrays([part.column("row_id"), part.column("no"), pa.array(ids, pa.binary())], names=["row_id", "no", "ids"])

    return run


def _join_ids(path: str, pattern: str, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 16):
                part = batch.slice(at, 16)
                whole = [np.frombuffer(b"".join(p["ids"] for p in parts), "<i4").tolist() for parts in part.column("parts").to_pylist()]
                cols = [pa.array(c, t) for c, t in zip(zip(*(_summary(ids, coder) for ids in whole), strict=True), (pa.int64(), pa.string(), pa.string()), strict=True)]
                names = ["row_id", *_RESULT]
                if keep_ids:
                    cols.append(pa.array(whole, pa.list_(pa.int32())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays([part.column("row_id"), *cols], names=names)

    return run


def _encode_long(long: DataFrame, path: str, pattern: str, keep_ids: bool) -> DataFrame:
    """The distributed form: chunks of one text are dealt to many tasks and only offsets and ids come back together."""
    spark = long.sparkSession
    tail = ", ids array<int>" if keep_ids else ""
    rows = materialize(long.withColumn("row_id", F.monotonically_increasing_id()))
    chunks = rows.select("row_id", "text", F.explode(F.sequence(F.lit(0), F.expr(f"cast(ceil(length(text) / {CHUNK}) as int) - 1"))).alias("no"))
    chunks = chunks.select(
        "row_id", "no", (F.col("no") * CHUNK).cast("long").alias("start"), F.expr(f"substring(text, no * {CHUNK} + 1, {CHUNK + OVERLAP})").alias("chunk"), F.expr(f"length(text) <= (no + 1) * {CHUNK}").alias("last")
    )
    dealt = chunks.repartition(shuffle_partitions(spark), "row_id", "no")
    seen = materialize(dealt.mapInArrow(_pretokenise(pattern), "row_id long, no int, start long, chunk string, last boolean, head array<bigint>, tail array<bigint>, sizes binary"))
    # Stitches need the offsets near the seams alone.
    order = Window.partitionBy("row_id").orderBy("no")
    seam = F.array_min(F.array_intersect(F.lag("tail").over(order), "head"))
    seams = seen.select("row_id", "no", "start", "head", "tail").withColumn("seam", F.when(F.col("no") == 0, F.lit(0)).otherwise(seam).cast("long"))
    # Every seam found: spans run from seam to seam. Else the whole text is stitched in one place.
    per_row = seams.groupBy("row_id").agg(F.count(F.when(F.col("seam").isNull(), 1)).alias("open"))
    spans = seams.select("row_id", "no", "start", "seam", F.lead("seam").over(order).alias("to"))
    spans = materialize(spans.join(per_row, "row_id"))
    good = spans.filter("open = 0").select("row_id", "no", "seam", "to")
    pieces = seen.select("row_id", "no", "start", "chunk", "sizes").join(good, ["row_id", "no"])
    pieces = pieces.select("row_id", "no", "chunk", "sizes", F.expr("cast(seam - start as int)").alias("lo"), F.expr("cast(coalesce(to - start, length(chunk)) as int)").alias("hi"))
    ids = pieces.mapInArrow(_encode_span(path, pattern), "row_id long, no int, ids binary")
    parts = ids.groupBy("row_id").agg(F.sort_array(F.collect_list(F.struct("no", "ids"))).alias("parts"))
    joined = parts.mapInArrow(_join_ids(path, pattern, keep_ids), f"row_id long, n_tokens long, ids_sha256 string, decoded_sha256 string{tail}")
    done = joined.join(rows.select("row_id", "doc_id"), "row_id").drop("row_id")
    torn = rows.join(spans.filter("open > 0").select("row_id").distinct(), "row_id").select("doc_id", "text")
    id_type = rows.schema["doc_id"].dataType.simpleString()
    rest = torn.mapInArrow(_encode_stitched(path, pattern, keep_ids), f"doc_id {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string{tail}")
    return done.select(rest.columns).unionByName(rest)


def encode_stitched(text: str, coder: Coder, chunk: int = CHUNK, overlap: int = OVERLAP) -> list[int]:
    """One text, chunk by chunk, in one place."""
    cut = ((k, text[k : k + chunk + overlap]) for k in range(0, max(1, len(text)), chunk))
    return [i for piece in stitch(cut, coder.find) for i in coder.encode_piece(piece)]


def _encode_stitched(path: str, pattern: str, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = _coder(path, pattern)
        for batch in batches:
            for k in range(batch.num_rows):
                ids = encode_stitched(batch.column(1)[k].as_py() or "", coder)
                n, a, b = _summary(ids, coder)
                cols = [pa.array([n]), pa.array([a]), pa.array([b])] + [pa.array([ids], pa.list_(pa.int32()))] * keep_ids
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), *cols], names=["doc_id", *_RESULT] + ["ids"] * keep_ids)

    return run


def encode(docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text", keep_ids: bool = False) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of each document, and ``ids`` if they are to be kept.

    ``path`` is a rank file that every worker can open. Texts of one chunk are encoded where they are read, without a shuffle.
    """
    rows = columns(docs, doc_id=doc_id, text=text)
    id_type = rows.schema["doc_id"].dataType.simpleString()
    tail = ", ids array<int>" if keep_ids else ""
    is_long = F.coalesce(F.length("text"), F.lit(0)) > CHUNK
    short = rows.filter(~is_long).mapInArrow(_encode_whole(path, pattern, keep_ids), f"doc_id {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string{tail}")
    long = rows.filter(is_long)
    return short.unionByName(_encode_long(long, path, pattern, keep_ids)) if long.head(1) else short


def default_vocabulary() -> tuple[str, str]:
    """(path, pattern) of the installed byte-level vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), *default_vocabulary())
