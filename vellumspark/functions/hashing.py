"""A seeded 32-bit hash that any SQL engine with MD5 can repeat, and bit-vector helpers on 32-bit words."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def _digest(seed: Column | int, text: Column) -> Column:
    seed = F.lit(seed) if isinstance(seed, int) else seed
    return F.md5(F.concat_ws(":", seed.cast("string"), text))


def seeded_hash(seed: Column | int, text: Column) -> Column:
    """0 to 2**32 - 1: the first eight hex digits of MD5 over ``seed:text``."""
    return F.conv(F.substring(_digest(seed, text), 1, 8), 16, 10).cast("bigint")


def signature_words(text: Column, bits: int = 100) -> list[Column]:
    """Words of 32 bits (the last may have fewer); bit i is set if the hash with seed i is in the upper half, so if its first hex digit is 8 or more."""
    out = []
    for start in range(0, bits, 32):
        seeds = F.sequence(F.lit(start), F.lit(min(bits, start + 32) - 1))
        out.append(
            F.aggregate(seeds, F.lit(0).cast("bigint"), lambda acc, i: acc * 2 + F.when(_digest(i, text) >= "8", 1).otherwise(0).cast("bigint"))
        )
    return out


_TURNS = [t for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for t in four * 4]
_SINES = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]


def _md5_first(blocks: np.ndarray) -> np.ndarray:
    """The first word of MD5 over padded messages of one block each, 16 words a column."""
    a, b, c, d = (np.full(blocks.shape[1], x, np.uint32) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476))
    for i in range(64):
        if i < 16:
            f, g = d ^ (b & (c ^ d)), i
        elif i < 32:
            f, g = c ^ (d & (b ^ c)), (5 * i + 1) % 16
        elif i < 48:
            f, g = b ^ c ^ d, (3 * i + 5) % 16
        else:
            f, g = c ^ (b | ~d), 7 * i % 16
        f += a
        f += blocks[g]
        f += np.uint32(_SINES[i])
        a, d, c, b = d, c, b, b + (f << np.uint32(_TURNS[i]) | f >> np.uint32(32 - _TURNS[i]))
    return a + np.uint32(0x67452301)


def signature_array(texts: list[bytes], bits: int = 100) -> np.ndarray:
    """``signature_words`` of texts of one length, at most 50 bytes, as a (texts, words) matrix: all texts at once, some seeds at a time."""
    n, length = len(texts), len(texts[0]) if texts else 0
    if length > 50 or any(len(t) != length for t in texts):
        raise ValueError("texts of one length of at most 50 bytes are hashed at once")
    own = np.frombuffer(b"".join(texts), np.uint8).reshape(n, length)
    out = np.zeros((n, -(-bits // 32)), np.int64)
    for start in range(0, bits, 10):
        seeds = range(start, min(bits, start + 10))
        blocks = np.zeros((len(seeds), n, 64), np.uint8)
        for block, seed in zip(blocks, seeds, strict=True):
            lead = f"{seed}:".encode()
            block[:, : len(lead)] = np.frombuffer(lead, np.uint8)
            block[:, len(lead) : len(lead) + length] = own
            block[:, len(lead) + length] = 0x80
            block[:, 56:58] = np.frombuffer((8 * (len(lead) + length)).to_bytes(2, "little"), np.uint8)
        words = np.ascontiguousarray(blocks.reshape(-1, 64).view("<u4").T)
        # The digest's first byte is the low one of its first word.
        upper = (_md5_first(words) >> np.uint32(7) & np.uint32(1)).reshape(len(seeds), n)
        for bit, seed in zip(upper, seeds, strict=True):
            out[:, seed // 32] = out[:, seed // 32] * 2 + bit
    return out


def differing_bits(a: list[Column], b: list[Column]) -> Column:
    total = F.lit(0)
    for x, y in zip(a, b, strict=True):
        total = total + F.bit_count(x.bitwiseXOR(y))
    return total


def share_of_equal_bits(a: list[Column], b: list[Column], bits: int = 104) -> Column:
    """Of ``bits`` stored bits, padding included, how many agree."""
    return 1 - differing_bits(a, b) / bits
