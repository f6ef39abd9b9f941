"""Words of many texts at once as numpy arrays: places, owners and 64-bit hashes; texts packed for a shuffle."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql.types import BinaryType, StructField, StructType

BASE = 0x9E3779B97F4A7C15


def _powers(n: int) -> np.ndarray:
    up = np.full(n, BASE, np.uint64)
    up[0] = 1
    return np.cumprod(up, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads close values."""
    x = x.astype(np.uint64)
    high = x >> np.uint64(30)
    x ^= high
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= np.right_shift(x, np.uint64(27), out=high)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= np.right_shift(x, np.uint64(31), out=high)
    return x


@dataclass
class Words:
    """buf: the parts, each with one space between words and a line break at its end; start, end: of each word in
    buf; part: its part's number; hash: of its bytes."""

    buf: bytes
    start: np.ndarray
    end: np.ndarray
    part: np.ndarray
    hash: np.ndarray


def words_in(parts: list[bytes]) -> Words:
    """Words [^\\x20\\x09-\\x0D]+ of all parts, in order."""
    buf = b"\n".join([b" ".join(x.split()) for x in parts]) + b"\n"
    a = np.frombuffer(buf, np.uint8)
    end = np.flatnonzero((a == 32) | (a == 10))
    start = np.append(0, end[:-1] + 1)
    real = end > start
    part = np.cumsum(a[end] == 10) - (a[end] == 10)
    start, end, part = start[real], end[real], part[real]
    if not len(start):
        return Words(buf, start, end, part, np.zeros(0, np.uint64))
    size = end - start
    letters = a[(a != 32) & (a != 10)]
    heads = np.append(0, np.cumsum(size)[:-1])
    place = np.arange(len(letters), dtype=np.int32) - np.repeat(heads.astype(np.int32), size)
    value = _powers(int(size.max()))[place]
    value *= letters.astype(np.uint64) + np.uint64(1)
    return Words(buf, start, end, part, mix(np.add.reduceat(value, heads) + size.astype(np.uint64)))


#: The lowest bytes of a 64-bit number, by how many.
_LOW = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def line_words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words [^\\x20\\x09-\\x0D]+ of texts in order, and the number of the line of each, counted through; for each
    line the number of its text and its number in it. Words are hashed by eight bytes at a time."""
    buf = b"\n".join(texts) + b"\n" + bytes(8)
    a = np.frombuffer(buf, np.uint8)[:-8]
    gap = (a - np.uint8(9) < 5) | (a == 32)
    edge = np.flatnonzero(gap[1:] != gap[:-1])
    edge += 1
    if not gap[0]:
        edge = np.append(0, edge)
    start = edge[0::2].copy()
    size = edge[1::2] - start
    eight = np.ndarray((len(a),), "<u8", buf, strides=(1,))
    h = mix(eight[start] & _LOW[np.minimum(size, 8)])
    h += size.astype(np.uint64) * np.uint64(BASE)
    long, at = np.flatnonzero(size > 8), 8
    while len(long):
        h[long] = mix(h[long] ^ (eight[start[long] + at] & _LOW[np.minimum(size[long] - at, 8)]))
        at += 8
        long = long[size[long] > at]
    ends = np.flatnonzero(a == 10)
    words = np.searchsorted(start, np.append(0, ends[:-1] + 1))
    line = np.repeat(np.arange(len(ends)), np.diff(np.append(words, len(start))))
    n = np.array([x.count(b"\n") + 1 for x in texts], np.int64)
    return mix(h), line, np.repeat(np.arange(len(n)), n), np.arange(len(ends)) - np.repeat(np.cumsum(n) - n, n)


def press_bytes(data: bytes, level: int = 3) -> bytes:
    return zstandard.ZstdCompressor(level=level).compress(data)


def open_bytes(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)
