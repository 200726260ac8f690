"""The words of whole Arrow batches at once, as the column expressions of ``text`` have them, for steps that go over all texts.

Texts come lower-cased from the JVM (``lowered``); what is a word is asked of the JVM once, since Unicode versions differ.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that are split at once; a longer text is a slice of its own.
SLICE_BYTES = 8 << 20
_SPACE, _WORD, _MARK, _NEXT = 0, 1, 2, 3
_SPACES = np.array([9, 10, 11, 12, 13, 32])


def lowered(text: Column) -> Column:
    return F.lower(F.coalesce(text, F.lit("")))


def word_points(spark: SparkSession) -> np.ndarray:
    """A bit for each code point, packed: whether the JVM's regular expressions take it for a letter, a number or an underscore."""
    return _word_points(spark.sparkContext.applicationId)


@lru_cache(maxsize=1)
def _word_points(_: str) -> np.ndarray:
    points = np.concatenate([np.arange(0xD800), np.arange(0xE000, 0x110000)])
    every = points.astype("<u4").tobytes().decode("utf-32-le")
    jvm = SparkSession.getActiveSession().sparkContext._jvm
    marked = jvm.java.util.regex.Pattern.compile(r"[\p{L}\p{N}_]").matcher(every).replaceAll("w")
    out = np.zeros(0x110000, bool)
    out[points] = np.frombuffer(marked.encode("utf-32-le"), np.uint32) == ord("w")
    return np.packbits(out)


@dataclass(frozen=True)
class Words:
    """The words of ``rows`` texts, in order: of each its row and its place in ``known``, the distinct words."""

    row: np.ndarray
    code: np.ndarray
    known: pa.Array
    rows: int

    def only(self, kept: np.ndarray) -> Words:
        """Those whose entry in ``known`` is marked."""
        at = kept[self.code]
        return Words(self.row[at], self.code[at], self.known, self.rows)

    def tally(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """``row, code, n``: how often each row has each of its distinct words; sorted by row."""
        size = max(1, len(self.known))
        at, n = np.unique(self.row * size + self.code, return_counts=True)
        return at // size, at % size, n

    def joined(self) -> pa.Array:
        """Each row's words without anything between."""
        return pc.binary_join(pa.ListArray.from_arrays(ends(self.row, self.rows), self.known.take(pa.array(self.code))), "")


def ends(row: np.ndarray, rows: int) -> pa.Array:
    """Offsets of lists from the sorted rows of their items."""
    return pa.array(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=rows))]).astype(np.int32))


def slices(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about ``SLICE_BYTES`` of text; no row is left out."""
    for batch in batches:
        total = np.cumsum(pc.binary_length(batch.column(column)).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + SLICE_BYTES, "right")))
            yield batch.slice(at, to - at)
            at = to


def _kinds(data: np.ndarray, points: np.ndarray) -> np.ndarray:
    """The kind of each byte of UTF-8; the bytes behind a word character's first are of its kind."""
    table = np.full(256, _MARK, np.uint8)
    table[:128][points[:128]] = _WORD
    table[_SPACES] = _SPACE
    table[0x80:0xC0] = _NEXT
    kind = table[data]
    lead = np.flatnonzero(data >= 0xC0)
    if len(lead):
        first = data[lead].astype(np.int32)
        size = 2 + (first >= 0xE0) + (first >= 0xF0)
        more = [data[np.minimum(lead + i, len(data) - 1)].astype(np.int32) & 0x3F for i in (1, 2, 3)]
        two, three = (first & 0x1F) << 6 | more[0], (first & 0x0F) << 12 | more[0] << 6 | more[1]
        point = np.where(size == 2, two, np.where(size == 3, three, (first & 0x07) << 18 | more[0] << 12 | more[1] << 6 | more[2]))
        word = points[point]
        kind[lead[word]] = _WORD
        for i in (1, 2, 3):
            kind[lead[word & (size > i)] + i] = _WORD
    return kind


def split(texts: pa.Array, points: np.ndarray | None = None) -> Words:
    """``text.tokens`` of lower-case texts if ``points`` (``word_points``, unpacked) are given, else ``text.terms``."""
    texts = texts.cast(pa.string())
    offsets = np.frombuffer(texts.buffers()[1], np.int32, len(texts) + 1, 4 * texts.offset).astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    if points is None:
        table = np.full(256, _WORD, np.uint8)
        table[_SPACES] = _SPACE
        kind = table[data]
    else:
        kind = _kinds(data, points)
    # A word begins where none is before it in its row; each mark is its own.
    begins = np.zeros(len(data) + 1, bool)
    begins[offsets] = True
    begins = begins[:-1]
    begins[1:] |= kind[:-1] != _WORD
    begins &= kind == _WORD
    begins |= kind == _MARK
    kept = kind != _SPACE
    at = np.flatnonzero(begins)
    place = np.cumsum(kept, dtype=np.int32)
    starts = np.append(place[at] - 1, place[-1] if len(place) else 0).astype(np.int32)
    coded = pa.StringArray.from_buffers(len(at), pa.py_buffer(starts), pa.py_buffer(data[kept])).dictionary_encode()
    row = np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(at, offsets)))
    return Words(row, coded.indices.to_numpy().astype(np.int64), coded.dictionary, len(texts))
