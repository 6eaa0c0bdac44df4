"""Word hashes and packed integer columns for the Arrow operators."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

_BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_POWERS: dict[tuple[int, bool], np.ndarray] = {}


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def long_word_hashes(words: list[bytes]) -> np.ndarray:
    """128 bits of each word, as two numbers."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words)), ">u8").astype(np.uint64).reshape(-1, 2)


def _powers(base: int, inverse: bool, n: int) -> np.ndarray:
    have = _POWERS.get((base, inverse))
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        steps = np.full(size, pow(base, -1, 2**64) if inverse else base, np.uint64)
        steps[0] = 1
        have = _POWERS[base, inverse] = np.cumprod(steps, dtype=np.uint64)
    return have[:n]


def window_hashes(h: np.ndarray, length: int, base: int = 0) -> np.ndarray:
    """A 64-bit polynomial hash of each run of `length` word hashes."""
    n = len(h) - length + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * _powers(_BASES[base], False, len(h)), dtype=np.uint64, out=sums[1:])
    return (sums[length:] - sums[:-length]) * _powers(_BASES[base], True, n)


def pack_ints(a: np.ndarray) -> bytes:
    """int64 values as their least value and the differences to it, each in the fewest whole bytes of 1, 2, 4 or 8 that hold all."""
    if not len(a):
        return b""
    low = int(a.min())
    rest = (a.astype(np.int64) - np.int64(low)).view(np.uint64)
    top = int(rest.max())
    width = 1 if top < 1 << 8 else 2 if top < 1 << 16 else 4 if top < 1 << 32 else 8
    return struct.pack("<Bq", width, low) + rest.astype(f"<u{width}").tobytes()


def unpack_ints(b: bytes) -> np.ndarray:
    if not b:
        return np.empty(0, np.int64)
    width, low = struct.unpack_from("<Bq", b)
    return np.frombuffer(b, f"<u{width}", offset=9).astype(np.uint64).view(np.int64) + np.int64(low)


def pack_sorted(a: np.ndarray) -> bytes:
    """Ascending int64 values as the first and their steps."""
    return struct.pack("<q", int(a[0])) + pack_ints(np.diff(a)) if len(a) else b""


def unpack_sorted(b: bytes) -> np.ndarray:
    if not b:
        return np.empty(0, np.int64)
    (first,) = struct.unpack_from("<q", b)
    return np.concatenate([[first], first + np.cumsum(unpack_ints(b[8:]))])


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of at most `rows` rows, so that few texts are Python objects at once."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)
