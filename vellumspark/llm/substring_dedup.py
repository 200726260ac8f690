"""Suffix-array dedup: removes every byte that lies in a string of ``LENGTH`` bytes which also starts earlier.

A suffix array of a whole corpus does not fit one machine, so the corpus is first reduced, without loss, to the places where
sorting decides anything:

1. Each window of LENGTH bytes is assigned to its least K-gram by hash. Equal windows have the same one at the same offset, so only
   windows of equal K-grams can be equal. Runs of windows with one K-gram are dealt by its hash, packed, after each
   batch has kept the first of its equal runs. A K-gram with more than ``MANY_RUNS`` different runs in a batch sends a flag
   alone to its bucket; its runs are dealt by their own bytes as well.
2. Of runs with equal K-gram and equal bytes all but the first are removed as a whole. Runs that share
   their K-gram with different runs are kept once each: only here can windows be equal in part.
3. Those runs' bytes are fetched and dealt by the middle part that any equal windows of theirs must share. That part
   becomes one symbol, the rests hang on it left and right, and suffix arrays (linear grouping on Lyndon prefixes) put equal
   windows next to each other; of each group all but the first window are removed. What hangs on a frequent middle part is
   first split by longer ones (``FINER``), the longest being whole windows, so that no task gets one part's places all together.
4. Removed ranges are joined with the texts, united and cut out.

Earlier is a smaller doc_id, or the same document and an earlier start; all is judged on the input. Runs are told apart
by two 64-bit hashes together, middle parts by one.

Defined cases: null texts are empty; texts shorter than LENGTH lose nothing; matches never cross documents; rows with one doc_id
count as documents of their own in the order of their texts, a null doc_id sorts first; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytehash import Ranges, mix
from .common import columns, materialize, numbered, shuffle_partitions, table, unique_ids
from .suffix_array import suffix_array

LENGTH = 100
#: Bytes of a K-gram. What equal windows share on one side of it is (LENGTH - K) / 2 at least.
K = 32
HALF = (LENGTH - K) // 2
#: Bytes of text that are hashed together, and symbols that are sorted together unless one group has more.
GROUP_BYTES, SORT_SYMBOLS = 1 << 20, 1 << 17
#: Different runs of one K-gram in a batch of texts from which they are dealt by their bytes.
MANY_RUNS = 16
#: Bytes left and right of the middle part at each step, which is split into the next: 35 windows, then 5, then 1.
FINER = (HALF, 4, 0)
#: A middle part is frequent from so many pieces on; MAX_FREQUENT of them at most are split, the most frequent ones. One piece in
#: SAMPLE, by hash, is counted for that, which decides how the work is dealt but not what is found.
FREQUENT, MAX_FREQUENT, SAMPLE = 4096, 100_000, 16
#: Bytes of text a bucket at most, on average: a worker holds one bucket's texts at a time, whatever the size of the corpus.
BUCKET_BYTES = 16 << 20

_HIGH = np.uint64(0xFFFFFFFF00000000)
_LOW = np.uint64(0xFFFFFFFF)
#: A run: hashes of its K-gram and of its bytes, its document, where it starts, its length and the K-gram's place in it.
RUN = np.dtype([("gram", "<u8"), ("body", "<u8"), ("doc", "<i8"), ("at", "<u4"), ("n", "u1"), ("rel", "u1")])
MARK = np.dtype([("doc", "<i8"), ("at", "<u4"), ("n", "<u4")])
REQUEST = np.dtype([("gram", "<u8"), ("doc", "<i8"), ("at", "<u4"), ("n", "u1"), ("rel", "u1")])
#: What hangs on one middle part: its hash, the first window's document and start, bytes left and right of the middle part.
PIECE = np.dtype([("key", "<u8"), ("doc", "<i8"), ("at", "<u4"), ("left", "u1"), ("right", "u1"), ("text", "u1", 2 * HALF)])


def runs_of(texts: list[bytes], docs: np.ndarray) -> np.ndarray:
    """The runs of some texts as RUN rows."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    if not (sizes >= LENGTH).any():
        return np.zeros(0, RUN)
    data = np.frombuffer(b"".join(texts), np.uint8)
    ranges = Ranges(data)
    grams = ranges.sliding(K)
    packed = (grams & _HIGH) | np.arange(len(grams), dtype=np.uint64)
    # Least packed value of LENGTH - K + 1 neighbours, by doubling.
    span, least = 1, packed
    want = LENGTH - K + 1
    while 2 * span <= want:
        least = np.minimum(least[:-span], least[span:])
        span *= 2
    if want > span:
        least = np.minimum(least[: len(least) - (want - span)], least[want - span :])
    begin = np.concatenate([[0], np.cumsum(sizes)])
    valid = np.zeros(len(least) + 1, bool)
    for lo, hi in zip(begin[:-1], begin[1:] - LENGTH + 1, strict=True):
        if hi > lo:
            valid[lo:hi] = True
    where = (least & _LOW).astype(np.int64)
    opens = valid[:-1].copy()
    opens[1:] &= ~valid[:-2] | (where[1:] != where[:-1])
    first_windows = begin[:-1][sizes >= LENGTH]
    opens[first_windows] = True
    st = np.flatnonzero(opens)
    of = np.searchsorted(begin, st, "right") - 1
    stop = np.minimum(np.append(st[1:], len(least)), begin[of + 1] - LENGTH + 1)
    p = where[st]
    out = np.zeros(len(st), RUN)
    out["gram"] = grams[p]
    out["rel"] = p - st
    out["n"] = stop - st + LENGTH - 1
    out["body"] = mix(ranges(st, stop + LENGTH - 1) + out["rel"].astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + out["n"].astype(np.uint64))
    out["doc"] = docs[of]
    out["at"] = st - begin[of]
    return out


def first_runs(runs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first of each set of equal runs, and which rows are others; the rows are sorted first."""
    runs = runs[np.lexsort((runs["at"], runs["doc"], runs["body"], runs["gram"]))]
    same = np.zeros(len(runs), bool)
    same[1:] = (runs["gram"][1:] == runs["gram"][:-1]) & (runs["body"][1:] == runs["body"][:-1])
    return runs, same


def _marks(runs: np.ndarray) -> np.ndarray:
    out = np.zeros(len(runs), MARK)
    for name in ("doc", "at", "n"):
        out[name] = runs[name]
    return out


def _bucket(values: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(values.astype(np.uint64)) % np.uint64(buckets)).astype(np.int32)


def _blobs(buckets: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, list[bytes]]:
    """The rows of each bucket that has any, as bytes."""
    order = np.argsort(buckets, kind="stable")
    rows, b = rows[order], buckets[order]
    at = np.searchsorted(b, np.arange(n + 1))
    full = np.flatnonzero(np.diff(at))
    return full.astype(np.int32), [rows[at[k] : at[k + 1]].tobytes() for k in full]


def _batch_of(kinds: list[tuple[str, np.ndarray, list[bytes]]], names=("bucket", "kind", "blob")) -> pa.RecordBatch:
    buckets = np.concatenate([b for _, b, _ in kinds]) if kinds else np.zeros(0, np.int32)
    return pa.RecordBatch.from_arrays(
        [pa.array(buckets, pa.int32()), pa.array([k for k, b, _ in kinds for _ in b], pa.string()), pa.array([x for _, _, blobs in kinds for x in blobs], pa.binary())], names=list(names)
    )


def _texts(column: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    first, group, size = 0, [], 0
    for k, t in enumerate(column.to_pylist()):
        group.append((t or "").encode("utf-8", "surrogatepass"))
        size += len(group[-1])
        if size >= GROUP_BYTES:
            yield first, group
            first, group, size = k + 1, [], 0
    if group:
        yield first, group


_BLOB = "bucket int, kind string, blob binary"


def _find_runs(buckets: int, many: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs = batch.column(0).to_numpy(zero_copy_only=False)
            found = [runs_of(texts, docs[first : first + len(texts)]) for first, texts in _texts(batch.column(1))]
            runs = np.concatenate(found) if found else np.zeros(0, RUN)
            if not len(runs):
                continue
            runs, same = first_runs(runs)
            b = _bucket(runs["gram"], buckets)
            left, at = runs[~same], b[~same]
            _, opens, of, count = np.unique(left["gram"], return_index=True, return_inverse=True, return_counts=True)
            often = count[of] > many
            flags = opens[count > many]
            yield _batch_of(
                [
                    ("run", *_blobs(at[~often], left[~often], buckets)),
                    ("dealt", *_blobs(_bucket(left["gram"][often] ^ left["body"][often], buckets), left[often], buckets)),
                    ("flag", *_blobs(at[flags], left["gram"][flags], buckets)),
                    ("mark", *_blobs(_bucket(runs["doc"][same], buckets), _marks(runs[same]), buckets)),
                ]
            )

    return run


def _joined(table: pa.Table, kind: str, dtype: np.dtype) -> np.ndarray:
    return np.frombuffer(b"".join(x for x, k in zip(table.column("blob").to_pylist(), table.column("kind").to_pylist(), strict=True) if k == kind), dtype)


def _table_of(kinds) -> pa.Table:
    return pa.Table.from_batches([_batch_of(kinds)])


def _settle_runs(buckets: int):
    """All runs of a K-gram: others of equal ones become marks, and first ones beside different ones requests.

    A run that is dealt by its bytes has different ones beside it, and so has each run of a flagged K-gram. Marks of the batches lie in their
    documents' buckets, since a frequent passage has as many as texts, and pass through.
    """

    def run(table: pa.Table) -> pa.Table:
        runs, same = first_runs(_joined(table, "run", RUN))
        dealt, again = first_runs(_joined(table, "dealt", RUN))
        marks = np.concatenate([_joined(table, "mark", MARK), _marks(runs[same]), _marks(dealt[again])])
        left = runs[~same]
        near = np.zeros(len(left) + 1, bool)
        near[1:-1] = left["gram"][1:] == left["gram"][:-1]
        asked = np.concatenate([left[near[:-1] | near[1:] | np.isin(left["gram"], _joined(table, "flag", np.dtype("<u8")))], dealt[~again]])
        requests = np.zeros(len(asked), REQUEST)
        for name in REQUEST.names:
            requests[name] = asked[name]
        return _table_of([("mark", *_blobs(_bucket(marks["doc"], buckets), marks, buckets)), ("request", *_blobs(_bucket(requests["doc"], buckets), requests, buckets))])

    return run


def _spans(rows: np.ndarray) -> dict[int, np.ndarray]:
    """Rows by document."""
    rows = rows[np.argsort(rows["doc"], kind="stable")]
    cut = np.flatnonzero(np.diff(rows["doc"])) + 1
    return {int(part["doc"][0]): part for part in np.split(rows, cut) if len(part)}


def pieces_of(text: bytes, requests: np.ndarray) -> np.ndarray:
    """Up to two PIECE rows for each run: its windows whose equals must share HALF bytes left of the K-gram, and the others."""
    data = np.frombuffer(text, np.uint8)
    at, p = requests["at"].astype(np.int64), requests["at"].astype(np.int64) + requests["rel"]
    last = at + requests["n"] - LENGTH
    ranges = Ranges(data)
    out = []
    for side, lo, hi, mid, end in (("l", at, np.minimum(last, p - HALF), p - HALF, p + K), ("r", np.maximum(at, p - HALF + 1), np.minimum(last, p), p, p + K + HALF)):
        ok = hi >= lo
        if not ok.any():
            continue
        lo, hi, mid, end = lo[ok], hi[ok], mid[ok], end[ok]
        rows = np.zeros(len(lo), PIECE)
        rows["key"] = mix(ranges(mid, end) + np.uint64(side == "l"))
        rows["doc"], rows["at"] = requests["doc"][ok], lo
        rows["left"], rows["right"] = mid - lo, hi + LENGTH - end
        # Bytes before the middle part, then those after it.
        cols = np.arange(2 * HALF)
        left, right = rows["left"].astype(np.int64)[:, None], rows["right"].astype(np.int64)[:, None]
        source = np.where(cols < left, lo[:, None] + cols, end[:, None] + cols - left)
        rows["text"] = np.where(cols < left + right, data[np.minimum(source, len(data) - 1)], 0)
        out.append(rows)
    return np.concatenate(out) if out else np.zeros(0, PIECE)


def _fetch(buckets: int):
    def run(texts: pa.Table, blobs: pa.Table) -> pa.Table:
        asked = _spans(_joined(blobs, "request", REQUEST))
        found = [pieces_of((t or "").encode("utf-8", "surrogatepass"), asked[d]) for d, t in zip(texts.column("row_no").to_pylist(), texts.column("text").to_pylist(), strict=True) if d in asked]
        pieces = np.concatenate(found) if found else np.zeros(0, PIECE)
        return _table_of([("piece", *_blobs(_bucket(pieces["key"], buckets), pieces, buckets))])

    return run


def finer_pieces(pieces: np.ndarray, rest: int, into: int) -> np.ndarray:
    """PIECE rows for the windows of ``pieces`` under longer middle parts, which leave ``into`` bytes of ``rest`` left and right.

    A window has between 0 and ``rest`` bytes left of the middle part. Those with g * (into + 1) to g * (into + 1) + into share
    the first of them and what all have on the right: that is the longer middle part.
    """
    data = np.ascontiguousarray(pieces["text"]).ravel()
    ranges = Ranges(data)
    base = np.arange(len(pieces), dtype=np.int64) * (2 * HALF)
    left, right = pieces["left"].astype(np.int64), pieces["right"].astype(np.int64)
    out = []
    for low in range(0, rest + 1, into + 1):
        # Windows by their bytes on the left, from few to many.
        few, most = np.maximum(low, rest - right), np.minimum(low + into, left)
        ok = np.flatnonzero(most >= few)
        if not len(ok):
            continue
        few, most, more = few[ok], most[ok], rest - low - into
        middle = base[ok] + left[ok]
        rows = np.zeros(len(ok), PIECE)
        mixed = pieces["key"][ok] + ranges(middle - low, middle) * np.uint64(0xC2B2AE3D27D4EB4F) + ranges(middle, middle + more) * np.uint64(0x9E3779B97F4A7C15)
        rows["key"] = mix(mixed + np.uint64(low + 1))
        rows["doc"], rows["at"] = pieces["doc"][ok], pieces["at"][ok] + (left[ok] - most)
        rows["left"], rows["right"] = most - low, low + into - few
        cols = np.arange(2 * HALF)
        before, both = (most - low)[:, None], (most - few + into)[:, None]
        source = np.where(cols < before, (middle - most)[:, None] + cols, (middle + more)[:, None] + cols - before)
        rows["text"] = np.where(cols < both, data[np.minimum(source, len(data) - 1)], 0)
        out.append(rows)
    return np.concatenate(out) if out else np.zeros(0, PIECE)


def first_pieces(pieces: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first piece of each middle part that is a whole window, and MARK rows of the others."""
    pieces = pieces[np.lexsort((pieces["at"], pieces["doc"], pieces["key"]))]
    again = np.zeros(len(pieces), bool)
    again[1:] = pieces["key"][1:] == pieces["key"][:-1]
    marks = np.zeros(int(again.sum()), MARK)
    marks["doc"], marks["at"], marks["n"] = pieces["doc"][again], pieces["at"][again], LENGTH
    return pieces[~again], marks


def later_windows(pieces: np.ndarray, rest: int = HALF) -> np.ndarray:
    """MARK rows of the windows of ``pieces`` (sorted by key) that an earlier window equals, from one suffix array."""
    n, width = len(pieces), rest + 1
    new = np.ones(n, bool)
    new[1:] = pieces["key"][1:] != pieces["key"][:-1]
    key = np.cumsum(new)
    left, right = pieces["left"].astype(np.int64), pieces["right"].astype(np.int64)
    sizes = left + right + 2
    begin = np.concatenate([[0], np.cumsum(sizes)])
    keys = int(key[-1])
    # 1 ends a piece, then come the middle parts, then the bytes.
    symbols = np.ones(int(begin[-1]), np.int32)
    cols = np.arange(2 * HALF)
    inside = cols < (left + right)[:, None]
    target = begin[:-1, None] + cols + (cols >= left[:, None])
    symbols[target[inside]] = pieces["text"][inside].astype(np.int32) + keys + 2
    symbols[begin[:-1] + left] = key + 1
    array = np.asarray(suffix_array(symbols.tolist()), np.int64)
    # Windows start at a piece's first symbols, as many as there are rests to shift over.
    count = left + right - width + 2
    starts = np.repeat(begin[:-1], count) + np.concatenate([np.arange(c) for c in count])
    owner = np.full(len(symbols), -1, np.int64)
    owner[starts] = np.repeat(np.arange(n), count)
    array = array[owner[array] >= 0]
    views = np.lib.stride_tricks.sliding_window_view(symbols, width)
    rows = views[array]
    fresh = np.ones(len(array), bool)
    fresh[1:] = (rows[1:] != rows[:-1]).any(axis=1)
    group = np.cumsum(fresh)
    who = owner[array]
    at = pieces["at"][who].astype(np.int64) + array - begin[who]
    order = np.lexsort((at, pieces["doc"][who], group))
    g = group[order]
    later = order[1:][g[1:] == g[:-1]]
    out = np.zeros(len(later), MARK)
    out["doc"], out["at"], out["n"] = pieces["doc"][who[later]], at[later], LENGTH
    return out


def _count_keys(sample: int):
    """``key, c``: how many pieces of a sample by hash each middle part has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                pieces = np.frombuffer(blob, PIECE)
                drawn = mix(pieces["doc"].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + pieces["at"]) % np.uint64(sample) == 0
                keys, c = np.unique(pieces["key"][drawn].view(np.int64), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(c, pa.int64())], names=["key", "c"])

    return run


def _frequent(pieces: DataFrame) -> np.ndarray:
    """The middle parts with more than about FREQUENT pieces: MAX_FREQUENT at most."""
    counts = pieces.select("blob").mapInArrow(_count_keys(SAMPLE), "key long, c long").groupBy("key").agg(F.sum("c").alias("c"))
    found = counts.filter(F.col("c") * SAMPLE > FREQUENT).orderBy(F.desc("c"), "key").limit(MAX_FREQUENT).select("key").toPandas()
    return np.sort(found["key"].to_numpy(np.int64).view(np.uint64))


def _split_frequent(frequent: np.ndarray, rest: int, into: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for bucket, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                pieces = np.frombuffer(blob, PIECE)
                often = np.isin(pieces["key"], frequent)
                kinds = [("piece", np.array([bucket], np.int32), [pieces[~often].tobytes()])] if not often.all() else []
                if often.any():
                    finer, marks = finer_pieces(pieces[often], rest, into), np.zeros(0, MARK)
                    if not into:
                        finer, marks = first_pieces(finer)
                    kinds += [("finer", *_blobs(_bucket(finer["key"], buckets), finer, buckets)), ("mark", *_blobs(_bucket(marks["doc"], buckets), marks, buckets))]
                yield _batch_of(kinds)

    return run


def _later(pieces: DataFrame, buckets: int) -> list[DataFrame]:
    """Tables of marks: the windows of all pieces that earlier ones equal."""
    found = []
    for rest, into in zip(FINER, (*FINER[1:], None), strict=True):
        finer = None
        frequent = _frequent(pieces) if rest else ()
        if len(frequent):
            parts = materialize(pieces.select("bucket", "blob").mapInArrow(_split_frequent(frequent, rest, into, buckets), _BLOB), compression="zstd")
            found.append(parts.filter("kind = 'mark'"))
            pieces, finer = parts.filter("kind = 'piece'"), parts.filter("kind = 'finer'").withColumn("kind", F.lit("piece"))
        found.append(materialize(pieces.groupBy("bucket").applyInArrow(_sort_pieces(buckets, rest), _BLOB), compression="zstd"))
        if finer is None:
            break
        pieces = finer
    return found


def _sort_pieces(buckets: int, rest: int):
    def run(table: pa.Table) -> pa.Table:
        pieces = _joined(table, "piece", PIECE)
        if not rest:
            marks = first_pieces(pieces)[1]
            return _table_of([("mark", *_blobs(_bucket(marks["doc"], buckets), marks, buckets))])
        pieces = pieces[np.argsort(pieces["key"], kind="stable")]
        near = np.zeros(len(pieces) + 1, bool)
        near[1:-1] = pieces["key"][1:] == pieces["key"][:-1]
        pieces = pieces[near[:-1] | near[1:]]
        found, at = [], 0
        total = np.concatenate([[0], np.cumsum(pieces["left"].astype(np.int64) + pieces["right"] + 2)])
        ends = np.append(np.flatnonzero(pieces["key"][1:] != pieces["key"][:-1]) + 1, len(pieces)) if len(pieces) else []
        for k, end in enumerate(ends):
            if end == len(pieces) or total[ends[k + 1]] - total[at] > SORT_SYMBOLS:
                found.append(later_windows(pieces[at:end], rest))
                at = end
        marks = np.concatenate(found) if found else np.zeros(0, MARK)
        return _table_of([("mark", *_blobs(_bucket(marks["doc"], buckets), marks, buckets))])

    return run


def removed_runs(n: int, marks: np.ndarray | None) -> list[tuple[int, int]]:
    """The maximal removed runs of a text of n bytes."""
    if marks is None or not len(marks):
        return []
    depth = np.zeros(n + 1, np.int32)
    np.add.at(depth, marks["at"], 1)
    np.add.at(depth, marks["at"].astype(np.int64) + marks["n"], -1)
    gone = np.concatenate([[False], np.cumsum(depth)[:-1] > 0, [False]])
    edge = np.flatnonzero(np.diff(gone.astype(np.int8)))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def _cut(keep_text: bool):
    def run(texts: pa.Table, blobs: pa.Table) -> pa.Table:
        marks = _spans(_joined(blobs, "mark", MARK))
        rows = []
        for d, t in zip(texts.column("row_no").to_pylist(), texts.column("text").to_pylist(), strict=True):
            raw = (t or "").encode("utf-8", "surrogatepass")
            gone = removed_runs(len(raw), marks.get(d))
            kept, last = [], 0
            for lo, hi in gone:
                kept.append(raw[last:lo])
                last = hi
            body = b"".join([*kept, raw[last:]])
            row = (len(raw), len(raw) - len(body), len(gone), hashlib.sha256(body).hexdigest())
            rows.append((*row, body.decode("utf-8", "ignore") if gone else t) if keep_text else row)
        names = ["n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept_text"] * keep_text
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string()] + [pa.string()] * keep_text
        cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)] if rows else [pa.array([], t) for t in types]
        carried = [c for c in texts.schema.names if c.startswith("carried_")]
        return pa.table([texts.column("doc_id"), *[texts.column(c) for c in carried], *cols], names=["doc_id", *carried, *names])

    return run


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keep_text: bool = False, carry: list[str] | None = None) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` of each document, ``kept_text`` if asked for, and the ``carry`` columns.

    The kept text drops what is left of a character that was cut in part. Unique integer doc_ids serve as they are;
    otherwise rows are numbered in order of doc_id and text.
    """
    carried = carry or []
    rows = columns(docs, doc_id=doc_id, text=text, **{f"carried_{k}": c for k, c in enumerate(carried)})
    spark = docs.sparkSession
    kind = rows.schema["doc_id"].dataType.simpleString()
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(2 * shuffle_partitions(spark), -(-size // BUCKET_BYTES))
    if kind in ("tinyint", "smallint", "int", "bigint") and unique_ids(rows):
        rows = rows.withColumn("row_no", F.col("doc_id").cast("long"))
    else:
        rows = numbered(rows)
    runs = rows.select("row_no", "text").mapInArrow(_find_runs(n, MANY_RUNS), _BLOB)
    settled = materialize(runs.groupBy("bucket").applyInArrow(_settle_runs(n), _BLOB), compression="zstd")
    # The same bucket as _bucket() of a document, so that a group of texts meets the group of its blobs.
    extra = "".join(f", {c} {rows.schema[c].dataType.simpleString()}" for c in rows.columns if c.startswith("carried_"))
    rows = rows.select("doc_id", "text", "row_no", *[c for c in rows.columns if c.startswith("carried_")])
    placed = rows.mapInArrow(_place(n), f"doc_id {kind}, text string, row_no long{extra}, bucket int")
    asked = settled.filter("kind = 'request'")
    pieces = materialize(placed.select("row_no", "text", "bucket").groupBy("bucket").cogroup(asked.groupBy("bucket")).applyInArrow(_fetch(n), _BLOB), compression="zstd")
    marks = settled.filter("kind = 'mark'")
    for later in _later(pieces, n):
        marks = marks.unionByName(later)
    tail = ", kept_text string" if keep_text else ""
    cut = placed.groupBy("bucket").cogroup(marks.groupBy("bucket")).applyInArrow(_cut(keep_text), f"doc_id {kind}{extra}, n_bytes long, n_removed long, n_spans long, kept_sha256 string{tail}")
    facts = ["n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept_text"] * keep_text
    return cut.select("doc_id", *facts, *[F.col(f"carried_{k}").alias(c) for k, c in enumerate(carried)])


def _place(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b = _bucket(batch.column(2).to_numpy(zero_copy_only=False).astype(np.int64), buckets)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(b, pa.int32())], names=[*batch.schema.names, "bucket"])

    return run


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


#: Brute force in SQL: all windows, their first places, and the bytes that later ones cover. Texts are blobs, so that positions count bytes.
ORACLE = r"""
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS x FROM documents),
w AS (SELECT doc_id, s, md5_number(x[s + 1 : s + 100]) AS m FROM (SELECT doc_id, x, unnest(range(0, greatest(octet_length(x) - 99, 0))) AS s FROM d)),
first AS (SELECT m, min((doc_id, s)) AS f FROM w GROUP BY m HAVING count(*) > 1),
later AS (SELECT doc_id, s FROM w JOIN first USING (m) WHERE (doc_id, s) <> f),
island AS (
  SELECT doc_id, s, sum(CASE WHEN s <= p + 100 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY s) AS g
  FROM (SELECT doc_id, s, lag(s, 1, -1000) OVER (PARTITION BY doc_id ORDER BY s) AS p FROM later)
),
span AS (SELECT doc_id, g, min(s) AS lo, max(s) + 100 AS hi FROM island GROUP BY doc_id, g),
ends AS (SELECT doc_id, max(hi) AS last FROM span GROUP BY doc_id),
edges AS (
  SELECT doc_id, lo, hi, lag(hi, 1, 0) OVER (PARTITION BY doc_id ORDER BY lo) AS before FROM span
  UNION ALL
  SELECT d.doc_id, octet_length(x), NULL, coalesce(last, 0) FROM d LEFT JOIN ends USING (doc_id)
),
kept AS (
  SELECT e.doc_id, string_agg(CASE WHEN lo > before THEN hex(x[before + 1 : lo]) ELSE '' END, '' ORDER BY lo, hi NULLS LAST) AS k, count(hi) AS n_spans,
         coalesce(sum(hi - lo), 0) AS n_removed
  FROM edges e JOIN d USING (doc_id) GROUP BY e.doc_id
)
SELECT d.doc_id, CAST(octet_length(x) AS BIGINT) AS n_bytes, CAST(n_removed AS BIGINT) AS n_removed, CAST(n_spans AS BIGINT) AS n_spans,
       sha256(unhex(k)) AS kept_sha256
FROM d JOIN kept USING (doc_id)
"""
