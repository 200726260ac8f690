"""Media columns: MPEG audio.

``parse`` reads an MPEG audio stream (versions 1, 2, 2.5; layers I to III): it skips an ID3v2 tag, finds frames by their headers,
resynchronises after damage (a header counts if the next one follows where it says, or the stream ends there), reads
the Xing, Info or VBRI table, checks each frame's CRC-16 (of any layer) where it has one, and gives the exact duration and each frame's
offset. ``pack`` stores any bytes losslessly in a valid stream: silent MPEG-1 layer III mono frames at 48 kHz with CRC,
whose main data is all ancillary; a variable bit rate fits the last frame, an Info frame holds counts and a seek
table, an ID3v2 tag the payload's length and an ID3v1 tag the title.

Defined cases: null bytes are empty; a stream without frames has none and duration 0; a frame cut off by the end does
not count and is reported as junk bytes; free-format frames are not read; repeated rows are kept; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import columns, table

# Fixed values of ISO/IEC 11172-3 and 13818-3: kbit/s by bit-rate index, from 1 to 14.
RATES = {
    (1, 1): (32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
SAMPLE_RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
CRC_POLY, CRC_START = 0x8005, 0xFFFF

#: A payload is padded with zero bytes to a positive multiple of this.
UNIT = 64
OUT_ROWS = 128


def _crc_table() -> list[int]:
    table = []
    for byte in range(256):
        crc = byte << 8
        for _ in range(8):
            crc = ((crc << 1) ^ CRC_POLY if crc & 0x8000 else crc << 1) & 0xFFFF
        table.append(crc)
    return table


_CRC = _crc_table()


@lru_cache(maxsize=65536)
def crc16(data: bytes, bits: int | None = None) -> int:
    """The checksum of the first ``bits`` bits of ``data``, or of all."""
    whole, rest = divmod(8 * len(data) if bits is None else bits, 8)
    crc = CRC_START
    for byte in data[:whole]:
        crc = (crc << 8) & 0xFFFF ^ _CRC[crc >> 8 ^ byte]
    for k in range(rest):
        top = crc >> 15 ^ data[whole] >> 7 - k & 1
        crc = (crc << 1) & 0xFFFF ^ (CRC_POLY if top else 0)
    return crc


@dataclass(frozen=True)
class Header:
    version: int  #: 3, 2 or 0: MPEG-1, 2, 2.5
    layer: int
    protected: bool
    kbps: int
    rate: int
    mono: bool
    size: int
    samples: int
    bound: int = 32  #: subbands from here on share their bit allocation (joint stereo of layers I and II)

    @property
    def side(self) -> int:
        """Bytes of layer III's side information."""
        return (17 if self.mono else 32) if self.version == 3 else (9 if self.mono else 17)


@lru_cache(maxsize=65536)
def read_header(four: bytes) -> Header | None:
    """What the four bytes of a frame header say, or None where they are none."""
    if len(four) < 4 or four[0] != 0xFF or four[1] & 0xE0 != 0xE0:
        return None
    version, layer = four[1] >> 3 & 3, 4 - (four[1] >> 1 & 3)
    index, rate_index, padding = four[2] >> 4, four[2] >> 2 & 3, four[2] >> 1 & 1
    if version == 1 or layer == 4 or index in (0, 15) or rate_index == 3 or four[3] & 3 == 2:
        return None
    kbps, rate = RATES[1 if version == 3 else 2, layer][index - 1], SAMPLE_RATES[version][rate_index]
    if layer == 1:
        samples, size = 384, (12_000 * kbps // rate + padding) * 4
    else:
        samples = 576 if layer == 3 and version != 3 else 1152
        size = samples // 8 * 1000 * kbps // rate + padding
    bound = 4 * ((four[3] >> 4 & 3) + 1) if four[3] >> 6 == 1 and layer < 3 else 32
    return Header(version, layer, not four[1] & 1, kbps, rate, four[3] >> 6 == 3, size, samples, bound)


def syncsafe(four: bytes) -> int:
    return four[0] << 21 | four[1] << 14 | four[2] << 7 | four[3]


def _id3v2(data: bytes) -> tuple[int, dict[str, bytes]]:
    """Length of a leading ID3v2 tag, and its frames."""
    if len(data) < 10 or data[:3] != b"ID3" or max(data[6:10]) > 127:
        return 0, {}
    end = min(len(data), 10 + syncsafe(data[6:10]))
    at, tags = 10, {}
    while at + 10 <= end and data[at : at + 4].isalnum():
        n = syncsafe(data[at + 4 : at + 8]) if data[3] == 4 else int.from_bytes(data[at + 4 : at + 8], "big")
        if at + 10 + n > end:
            break
        tags[data[at : at + 4].decode("latin-1")] = data[at + 10 : at + 10 + n]
        at += 10 + n
    return end + (10 if data[5] & 0x10 else 0), tags


def _vbr(data: bytes, at: int, h: Header) -> dict | None:
    """The Xing, Info or VBRI table of the frame at ``at``."""
    body = at + 4 + 2 * h.protected
    x = body + h.side
    if h.layer == 3 and data[x : x + 4] in (b"Xing", b"Info"):
        kind, flags = data[x : x + 4].decode(), int.from_bytes(data[x + 4 : x + 8], "big")
        out, p = {"kind": kind}, x + 8
        for bit, name in ((1, "frames"), (2, "bytes")):
            if flags & bit:
                out[name], p = int.from_bytes(data[p : p + 4], "big"), p + 4
        if flags & 4:
            out["toc"] = list(data[p : p + 100])
        return out
    v = at + 36
    if data[v : v + 4] == b"VBRI" and len(data) >= v + 26:
        size, frames, entries, scale, width = struct.unpack(">IIHHH", data[v + 10 : v + 24])
        toc = [int.from_bytes(data[v + 26 + k * width : v + 26 + (k + 1) * width], "big") * scale for k in range(entries)] if width <= 4 else []
        return {"kind": "VBRI", "frames": frames, "bytes": size, "toc": toc}
    return None


@dataclass
class Stream:
    tags: dict[str, bytes] = field(default_factory=dict)
    title: bytes = b""  #: of the ID3v1 tag
    vbr: dict | None = None
    offsets: list[int] = field(default_factory=list)  #: of audio frames, the table's frame excluded
    headers: list[Header] = field(default_factory=list)
    samples: int = 0
    rate: int = 0
    crc_good: int = 0
    crc_bad: int = 0
    resyncs: int = 0
    junk: int = 0

    @property
    def seconds(self) -> tuple[int, int]:
        """The exact duration as a fraction, samples over sample rate."""
        return self.samples, self.rate or 1


# Fixed values of ISO/IEC 11172-3 and 13818-3, layer II: (subbands, bits of each one's allocation) runs, lowest subband first.
ALLOCATION = {
    "wide": ((11, 4), (12, 3), (4, 2)),
    "widest": ((11, 4), (12, 3), (7, 2)),
    "narrow": ((2, 4), (6, 3)),
    "narrow 32 kHz": ((2, 4), (10, 3)),
    "low rates": ((4, 4), (7, 3), (19, 2)),
}


def _allocation(h: Header) -> list[int]:
    """Bits of each subband's allocation in a layer II frame."""
    each = h.kbps // (1 if h.mono else 2)
    if h.version != 3:
        name = "low rates"
    elif each < 56:
        name = "narrow 32 kHz" if h.rate == 32000 else "narrow"
    else:
        name = "widest" if each >= 96 and h.rate != 48000 else "wide"
    return [bits for n, bits in ALLOCATION[name] for _ in range(n)]


def _protected_bits(data: bytes, at: int, h: Header) -> tuple[bytes, int] | None:
    """The bytes that a frame's CRC covers and how many of their bits: half the header, then layer III's side information, layer I's bit
    allocation, or layer II's allocation and scale factor selection; None where the frame is too short for them."""
    head, body = data[at + 2 : at + 4], at + 6
    channels = 1 if h.mono else 2
    if h.layer == 3:
        bits = 8 * h.side
    elif h.layer == 1:
        bits = 4 * (channels * min(h.bound, 32) + 32 - min(h.bound, 32))
    else:
        widths = _allocation(h)
        window = int.from_bytes(data[body : body + 64].ljust(64, b"\0"), "big")
        bits = used = 0
        for k, width in enumerate(widths):
            shared = k >= h.bound
            for _ in range(1 if shared else channels):
                value = window >> 512 - bits - width & (1 << width) - 1
                used += (channels if shared else 1) * (value > 0)
                bits += width
        bits += 2 * used
    n = -(-bits // 8)
    return (head + data[body : body + n], 16 + bits) if body + n <= at + h.size else None


def parse(data: bytes | None) -> Stream:
    data = bytes(data or b"")
    out = Stream()
    at, out.tags = _id3v2(data)
    end = len(data)
    if end - at >= 128 and data[end - 128 : end - 125] == b"TAG":
        end -= 128
        out.title = data[end + 3 : end + 33].rstrip(b"\0 ")
    locked, first = True, True
    while at < end:
        h = read_header(data[at : at + 4])
        fits = h is not None and at + h.size <= end
        # Out of step, or at the very start, one header is not enough: the next must follow where it says.
        if fits and (first or not locked):
            follower = at + h.size
            n = read_header(data[follower : follower + 4]) if follower < end else h
            fits = n is not None and (n.version, n.layer, n.rate) == (h.version, h.layer, h.rate)
        if not fits:
            if locked:
                locked = False
                out.resyncs += 1
            nxt = data.find(b"\xff", at + 1, end)
            nxt = end if nxt < 0 else nxt
            out.junk += nxt - at
            at = nxt
            continue
        locked = True
        vbr = _vbr(data, at, h) if first else None
        first = False
        if h.protected and (part := _protected_bits(data, at, h)) is not None:
            good = crc16(*part) == int.from_bytes(data[at + 4 : at + 6], "big")
            out.crc_good += good
            out.crc_bad += not good
        if vbr:
            out.vbr = vbr
        else:
            out.offsets.append(at)
            out.headers.append(h)
            out.samples += h.samples
            out.rate = out.rate or h.rate
        at += h.size
    return out


_SIDE = bytes(17)
#: Frame bytes by index at 48 kHz, and what a frame holds beside header, CRC and side information.
_SIZES = [3 * k for k in RATES[1, 3]]
_OVERHEAD = 4 + 2 + len(_SIDE)


def _frame_head(index: int) -> bytes:
    head = bytes([0xFF, 0xFA, (index + 1) << 4 | 1 << 2, 0xC0])
    return head + crc16(head[2:4] + _SIDE).to_bytes(2, "big") + _SIDE


def _id3v2_frame(name: bytes, body: bytes) -> bytes:
    n = len(body)
    return name + bytes([n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127]) + b"\0\0" + body


def pack(payload: bytes, title: bytes = b"payload") -> bytes:
    """A valid MPEG-1 layer III stream whose frames' ancillary data is ``payload``."""
    full = _SIZES[-1] - _OVERHEAD
    n, rest = divmod(len(payload), full)
    body = np.empty((n, _SIZES[-1]), np.uint8)
    if n:
        body[:, :_OVERHEAD] = np.frombuffer(_frame_head(len(_SIZES) - 1), np.uint8)
        body[:, _OVERHEAD:] = np.frombuffer(payload, np.uint8, n * full).reshape(n, full)
    audio = body.tobytes()
    if rest:
        index = next(k for k, size in enumerate(_SIZES) if size - _OVERHEAD >= rest)
        audio += _frame_head(index) + payload[n * full :] + bytes(_SIZES[index] - _OVERHEAD - rest)
    frames = n + (rest > 0)
    table_index = _SIZES.index(192)
    total = len(audio) + 192
    toc = bytes(min(255, (192 + min(frames * p // 100, n) * _SIZES[-1]) * 256 // total) for p in range(100))
    info = b"Xing" + struct.pack(">III", 7, frames, total) + toc
    table_frame = (_frame_head(table_index) + info).ljust(192, b"\0")
    tags = _id3v2_frame(b"TXXX", b"\0payload_bytes\0" + str(len(payload)).encode())
    size = len(tags)
    v2 = b"ID3\x04\0\0" + bytes([size >> 21 & 127, size >> 14 & 127, size >> 7 & 127, size & 127]) + tags
    v1 = b"TAG" + title[:30].ljust(30, b"\0") + bytes(94) + b"\xff"
    return v2 + table_frame + audio + v1


def unpack(data: bytes, stream: Stream | None = None) -> bytes | None:
    """The payload of a stream that ``pack`` wrote, or None where damage has cost payload bytes."""
    stream = stream or parse(data)
    size = stream.tags.get("TXXX", b"").rpartition(b"\0")[2]
    view = memoryview(data)
    out = b"".join(view[at + _OVERHEAD : at + h.size] for at, h in zip(stream.offsets, stream.headers, strict=True))
    whole = size.isdigit() and len(out) >= int(size) and not stream.crc_bad and (stream.vbr or {}).get("frames") == len(stream.offsets)
    return out[: int(size)] if whole else None


def pad(data: bytes, unit: int = UNIT) -> bytes:
    return data + bytes(-len(data) % unit or (0 if data else unit))


def feature(stream: Stream) -> str:
    """Durations, rates, checksums and a digest of the seek offsets, as one line."""
    kbps = sorted({h.kbps for h in stream.headers})
    seek = xx(stream.offsets)
    return f"mp3;frames={len(stream.offsets)};samples={stream.samples};rate={stream.rate};kbps={'-'.join(map(str, kbps[:1] + kbps[-1:] if len(kbps) > 1 else kbps))};crc={stream.crc_good}/{stream.crc_bad};resyncs={stream.resyncs};seek={seek}"


def xx(offsets: list[int]) -> str:
    return hashlib.md5(np.asarray(offsets, "<i8").tobytes()).hexdigest()[:16]


_STORED = ["doc_id", "n_bytes", "media"]


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, OUT_ROWS):
            part = batch.slice(at, OUT_ROWS)
            raw = [(t or "").encode("utf-8", "surrogatepass") for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(r) for r in raw], pa.int64()), pa.array([pack(pad(r)) for r in raw], pa.binary())], names=_STORED)


def store_texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_bytes, media``: each text's padded UTF-8 as an MPEG audio stream."""
    rows = columns(docs, doc_id=doc_id, text=text)
    return rows.mapInArrow(_store, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_bytes long, media binary")


_INDEX = "frames long, samples long, sample_rate int, duration_s double, vbr_frames long, crc_good long, crc_bad long, resyncs long, junk_bytes long, seek_offsets array<bigint>, title string"


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in _INDEX.split(", ")]
    types = [pa.int64(), pa.int64(), pa.int32(), pa.float64(), *[pa.int64()] * 5, pa.list_(pa.int64()), pa.string()]
    for batch in batches:
        for at in range(0, batch.num_rows, OUT_ROWS):
            part = batch.slice(at, OUT_ROWS)
            rows = []
            for media in part.column(1).to_pylist():
                s = parse(media)
                rows.append((len(s.offsets), s.samples, s.rate, s.samples / (s.rate or 1), (s.vbr or {}).get("frames"), s.crc_good, s.crc_bad, s.resyncs, s.junk, s.offsets, s.title.decode("latin-1")))
            cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), *cols], names=["media_id", *names])


def index_media(media: DataFrame, media_id: str = "doc_id", data: str = "media") -> DataFrame:
    """The parsed facts of each media value, with its frames' seek offsets."""
    rows = columns(media, media_id=media_id, data=data)
    return rows.mapInArrow(_index, f"media_id {rows.schema['media_id'].dataType.simpleString()}, {_INDEX}")


_DIGEST = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, frames long, samples long, duration_s double, seek_offsets array<bigint>, whole boolean"


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.int64()), pa.bool_()]
    names = [c.split()[0] for c in _DIGEST.split(", ")]
    for batch in batches:
        for at in range(0, batch.num_rows, OUT_ROWS):
            part = batch.slice(at, OUT_ROWS)
            rows = []
            for n, media in zip(part.column("n_bytes").to_pylist(), part.column("media").to_pylist(), strict=True):
                stream = parse(media)
                found = unpack(media, stream)
                payload = found or b""
                facts = (len(stream.offsets), stream.samples, stream.samples / (stream.rate or 1), stream.offsets, found is not None)
                rows.append((n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), feature(stream), *facts))
            cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
            yield pa.RecordBatch.from_arrays([part.column(0), *cols], names=["doc_id", *names])


def read_back(stored: DataFrame) -> DataFrame:
    """Digests of what ``store_texts`` stored, with each stream's frames, exact duration and seek offsets; a damaged value has ``whole`` false and an empty payload."""
    return stored.mapInArrow(_digest, f"doc_id {stored.schema['doc_id'].dataType.simpleString()}, {_DIGEST}")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_back(store_texts(table(spark, sf_dir, "documents")))
