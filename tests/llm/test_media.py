import hashlib
import random
import struct
import zlib

from vellumspark.llm import mpeg_audio as m


def test_pack_parse_round_trip():
    rnd = random.Random(1)
    for n in (64, 128, 936 // 8 * 8, 937, 938, 5000, 100_000):
        payload = rnd.randbytes(n)
        data = m.pack(payload)
        s = m.parse(data)
        assert m.unpack(data, s) == payload
        assert s.crc_bad == 0 and s.resyncs == 0 and s.junk == 0 and s.crc_good == len(s.offsets) + 1
        assert s.vbr["kind"] == "Xing" and s.vbr["frames"] == len(s.offsets) and s.samples == 1152 * len(s.offsets) and s.rate == 48000
        assert s.vbr["bytes"] == sum(h.size for h in s.headers) + 192
        assert all(data[a] == 0xFF for a in s.offsets) and s.title == b"payload"
        assert len(s.vbr["toc"]) == 100 and s.vbr["toc"] == sorted(s.vbr["toc"])


def test_resynchronises_after_damage():
    payload = bytes(range(256)) * 40
    data = m.pack(payload)
    s = m.parse(data)
    cut = s.offsets[4]
    torn = data[:cut] + b"\xff\xfb junk \xff\xe3" * 7 + data[cut:]
    t = m.parse(torn)
    assert t.resyncs == 1 and t.junk == 7 * 10 and len(t.offsets) == len(s.offsets) and m.unpack(torn, t) == payload
    lost = data[:cut] + data[cut + 11 :]
    u = m.parse(lost)
    assert u.resyncs == 1 and len(u.offsets) == len(s.offsets) - 1
    cut_off = m.parse(data[: s.offsets[-1] + 20])
    assert len(cut_off.offsets) == len(s.offsets) - 1 and cut_off.junk == 20


def test_checksum_finds_a_flipped_bit():
    data = bytearray(m.pack(b"x" * 4000))
    s = m.parse(bytes(data))
    data[s.offsets[1] + 8] ^= 4
    t = m.parse(bytes(data))
    assert (t.crc_bad, t.crc_good) == (1, s.crc_good - 1)


def test_other_streams():
    assert m.parse(None).offsets == [] and m.parse(b"").seconds == (0, 1) and m.parse(b"\xff" * 5000).offsets == []
    # MPEG-2 layer III at 22.05 kHz, 64 kbit/s, no CRC, and a VBRI table in the first frame.
    head = bytes([0xFF, 0xF3, 0x80, 0xC0])
    h = m.read_header(head)
    assert (h.version, h.layer, h.kbps, h.rate, h.samples, h.size, h.mono, h.protected) == (2, 3, 64, 22050, 576, 208, True, False)
    first = bytearray(head + bytes(h.size - 4))
    first[36:62] = b"VBRI" + struct.pack(">HHHIIHHHH", 1, 0, 75, 4 * 208, 3, 2, 1, 2, 1)
    first[62:66] = struct.pack(">HH", 208, 416)
    s = m.parse(bytes(first) + (head + bytes(h.size - 4)) * 3)
    assert s.vbr == {"kind": "VBRI", "frames": 3, "bytes": 832, "toc": [208, 416]} and s.samples == 3 * 576 and s.offsets == [208, 416, 624]
    # MPEG-1 layer II at 44.1 kHz and layer I at 32 kHz.
    assert m.read_header(bytes([0xFF, 0xFD, 0xA4, 0x00])).size == 144_000 * 192 // 48000
    one = m.read_header(bytes([0xFF, 0xFF, 0x18, 0x00]))
    assert (one.layer, one.samples, one.size) == (1, 384, 12_000 * 32 // 32000 * 4)
    # An ID3v2.3 tag with a text frame.
    body = b"TIT2" + (6).to_bytes(4, "big") + b"\0\0" + b"\0hello"
    tagged = b"ID3\x03\0\0" + bytes([0, 0, 0, len(body)]) + body + (head + bytes(204)) * 2
    t = m.parse(tagged)
    assert t.tags["TIT2"] == b"\0hello" and t.offsets == [10 + len(body), 10 + len(body) + 208]


def test_query_digests(spark):
    texts = [None, "", "a", "x" * 64, "é" * 5000, "y" * 300_000, "a"]
    docs = spark.createDataFrame([(i, t, b"") for i, t in enumerate(texts)], "doc_id long, text string, media binary")
    stored = m.store_texts(docs)
    got = {r["doc_id"]: r for r in m.read_back(stored).collect()}
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        pad = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"]) == (len(raw), len(pad))
        assert r["whole"] and r["frames"] == len(r["seek_offsets"]) and r["duration_s"] == r["samples"] / 48000 == r["frames"] * 1152 / 48000
        assert r["payload_sha256"] == hashlib.sha256(pad).hexdigest() and r["tail_crc32"] == zlib.crc32(pad[-64:])
    assert tuple(got[2])[1:] == tuple(got[6])[1:] and got[0]["media_sha256"] == got[1]["media_sha256"]
    facts = m.index_media(stored).collect()
    assert all(f["frames"] == len(f["seek_offsets"]) == f["vbr_frames"] and f["duration_s"] == f["samples"] / 48000 for f in facts)
    assert m.store_texts(docs.limit(0)).count() == 0


def _crc_by_bits(bits):
    crc = 0xFFFF
    for b in bits:
        crc = (crc << 1 ^ (0x8005 if (crc >> 15 ^ b) & 1 else 0)) & 0xFFFF
    return crc


def _bits(data):
    return [byte >> 7 - k & 1 for byte in data for k in range(8)]


def test_checksums_of_layers_one_and_two():
    """Frames of random bodies, their checksums set by a bit-by-bit reading of what each layer protects."""
    rnd = random.Random(3)
    # (second byte, third byte, fourth byte, protected bits after the header as a function of the body)
    one = lambda channels, bound: lambda body: 4 * (channels * bound + 32 - bound)

    def two(widths, channels, bound):
        def count(body):
            bits, at, used = _bits(body), 0, 0
            for k, w in enumerate(widths):
                for _ in range(channels if k < bound else 1):
                    used += (channels if k >= bound else 1) * any(bits[at : at + w])
                    at += w
            return at + 2 * used

        return count

    wide, widest, narrow, low = [4] * 11 + [3] * 12 + [2] * 4, [4] * 11 + [3] * 12 + [2] * 7, [4] * 2 + [3] * 6, [4] * 4 + [3] * 7 + [2] * 19
    cases = [
        (0xFE, 0xC0, 0x00, one(2, 32)), (0xFE, 0xC0, 0xC0, one(1, 32)), (0xFE, 0xC0, 0x50, one(2, 8)),
        (0xFC, 0xA4, 0x00, two(wide, 2, 32)), (0xFC, 0xC0, 0x00, two(widest, 2, 32)), (0xFC, 0x24, 0xC0, two(narrow, 1, 32)), (0xFC, 0xA4, 0x60, two(wide, 2, 12)),
        (0xF4, 0xA0, 0x00, two(low, 2, 32)),
    ]
    for second, third, fourth, count in cases:
        head = bytes([0xFF, second, third, fourth])
        h = m.read_header(head)
        frames = []
        for _ in range(4):
            body = rnd.randbytes(h.size - 6).replace(b"\xff", b"\x7f")
            crc = _crc_by_bits(_bits(head[2:]) + _bits(body)[: count(body)])
            frames.append(head + crc.to_bytes(2, "big") + body)
        s = m.parse(b"".join(frames))
        assert (s.crc_good, s.crc_bad, len(s.offsets)) == (4, 0, 4), (h, s.crc_good, s.crc_bad)
        damaged = bytearray(b"".join(frames))
        damaged[h.size + 6] ^= 0x10
        assert m.parse(bytes(damaged)).crc_bad == 1


def test_damage_is_a_status(spark):
    whole = m.pack(b"x" * 4000)
    bad = bytearray(whole)
    bad[m.parse(whole).offsets[1] + 8] ^= 4
    assert m.unpack(whole) == b"x" * 4000 and m.unpack(bytes(bad)) is None and m.unpack(b"") is None and m.unpack(whole[:2000]) is None
    rows = m.read_back(spark.createDataFrame([(1, 4000, whole), (1, 4000, whole), (2, 4000, bytes(bad))], "doc_id long, n_bytes long, media binary")).collect()
    assert sorted((r["doc_id"], r["whole"], r["payload_bytes"]) for r in rows) == [(1, True, 4000), (1, True, 4000), (2, False, 0)]
