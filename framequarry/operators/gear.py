"""Content-defined split points by a rolling gear hash, chunks that occur earlier in the corpus, and long matches inside a buffer.

The hash of a position depends on the 64 bytes before it at most, so all positions of a buffer are computed at once: h[i] is the sum of table[b[i - j]] << j.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framequarry.operators.encoder import common_length

# The table's step, the hash before the first byte, the window.
PRIME = 0x9E3779B185EBCA87
SEED = 0xFFFFFFFF
MIN_MATCH = 64


def gear_table() -> np.ndarray:
    return np.arange(1, 257, dtype=np.uint64) * np.uint64(PRIME)


def stop_mask(rate: int, min_match: int = MIN_MATCH) -> int:
    """Bits that must be 0 at a split; high ones, as they depend on a long window."""
    return ((1 << rate) - 1) << (min(min_match, 64) - rate) if 0 < rate <= min(min_match, 64) else (1 << rate) - 1


def _hashes(data: bytes) -> np.ndarray:
    """The hash after each byte."""
    n = len(data)
    h = gear_table()[np.frombuffer(data, np.uint8)]
    width = 1
    while width < 64:  # sums over 2, 4, ... 64 bytes
        later = np.zeros(n, np.uint64)
        later[width:] = h[:-width] << np.uint64(width)
        h = h + later
        width *= 2
    early = np.arange(min(64, n), dtype=np.uint64)  # the seed is still in the first 64 hashes
    at = early + np.uint64(1)
    h[: len(early)] += np.where(at < 64, np.uint64(SEED) << np.minimum(at, np.uint64(63)), np.uint64(0))
    return h


def split_points(data: bytes, rate: int = 7, min_match: int = MIN_MATCH) -> np.ndarray:
    """Offsets after which the hash fires, the first min_match bytes only feeding it."""
    if len(data) <= min_match:
        return np.empty(0, np.int64)
    fires = np.flatnonzero(_hashes(data) & np.uint64(stop_mask(rate, min_match)) == 0) + 1
    return fires[fires > min_match]


def _lowest(h: np.ndarray, width: int) -> np.ndarray:
    """The least of each run of `width` values that begins at a position, shorter at the end."""
    n = len(h)
    rows = np.full(-(-(n + width) // width) * width, np.iinfo(np.uint64).max)
    rows[:n] = h
    rows = rows.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : n + width - 1])


def match_points(data: bytes, rate: int = 7, min_match: int = MIN_MATCH) -> np.ndarray:
    """Split points, and the places whose hash is the least of 2**rate before and after them: texts of few different windows may have no split point, but never none of these."""
    if len(data) <= min_match:
        return np.empty(0, np.int64)
    h, width = _hashes(data), 1 << rate
    least = (h == _lowest(h, width)) & (h == _lowest(h[::-1], width)[::-1])
    fires = np.flatnonzero(least | (h & np.uint64(stop_mask(rate, min_match)) == 0)) + 1
    return fires[fires > min_match]


def splits(df: DataFrame, bytes_col: str, rate: int = 7, min_match: int = MIN_MATCH) -> DataFrame:
    """df's other columns with ord, start, end and chunk_hash (128 bits of BLAKE2b) of each content-defined chunk; the last ends with the buffer."""
    rest = [c for c in df.columns if c not in {bytes_col, "bytes_", "ord", "start", "end", "chunk_hash"}]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 256):
                b = whole.slice(i, 256)
                at, rows = [], []
                for k, x in enumerate(b.column("bytes_").to_pylist()):
                    x = x or b""
                    ends = [*split_points(x, rate, min_match).tolist()]
                    if x and (not ends or ends[-1] != len(x)):
                        ends.append(len(x))
                    for j, (s, e) in enumerate(zip([0, *ends], ends, strict=False)):
                        at.append(k)
                        rows.append((j, s, e, hashlib.blake2b(x[s:e], digest_size=16).digest()))
                names = [c for c in b.schema.names if c != "bytes_"]
                cols = list(zip(*rows, strict=True)) or [()] * 4
                take = pa.array(at, pa.int64())
                kinds = (pa.int32(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(c).take(take) for c in names), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], names=[*names, "ord", "start", "end", "chunk_hash"]
                )

    schema = df.select(*rest).schema.add("ord", "integer").add("start", "long").add("end", "long").add("chunk_hash", "binary")
    return df.select(*rest, F.col(bytes_col).cast("binary").alias("bytes_")).mapInArrow(run, schema)


def repeated_chunks(chunks: DataFrame, id_col: str, min_length: int = MIN_MATCH) -> DataFrame:
    """Chunks of at least min_length bytes whose bytes occur earlier, with first_id and first_start of the first occurrence.

    Equal chunks are told by length and a cryptographic hash. First occurrences come from an aggregation with map-side minima, so a chunk with a third of all rows is no hot key there;
    the join back has one row per chunk on one side, and adaptive execution splits the other.
    """
    size = F.col("end") - F.col("start")
    found = chunks.where(size >= min_length).withColumn("size_", size)
    first = found.groupBy("chunk_hash", "size_").agg(F.min(F.struct(F.col(id_col).alias("id"), "start")).alias("first_"), F.count("*").alias("times_")).where("times_ > 1")
    later = ~(F.col("first_.id").eqNullSafe(F.col(id_col)) & (F.col("first_.start") == F.col("start")))
    both = found.join(first.drop("times_"), ["chunk_hash", "size_"]).where(later)
    return both.select(*chunks.columns, F.col("first_.id").alias("first_id"), F.col("first_.start").alias("first_start"))


def matches_of(data: bytes, window: int, rate: int = 7, min_match: int = MIN_MATCH) -> list[tuple[int, int, int]]:
    """(start, length, distance) of long matches of a buffer, in order and without overlap.

    Candidates are match_points: the min_match bytes before one are looked up among those before earlier points no farther than the window. The latest, the earliest and the
    distance of the match before are tried, each extended both ways: back to the end of the match before, and forward as far as the bytes are equal. The longest is taken.
    """
    latest: dict[bytes, int] = {}
    earliest: dict[bytes, int] = {}
    out, done, before = [], 0, 0
    for p in match_points(data, rate, min_match).tolist():
        key = data[p - min_match : p]
        q = latest.get(key)
        latest[key] = p
        first = earliest.setdefault(key, p)
        if p < done:
            continue
        best = (0, 0, 0)
        for distance in {p - (p if q is None else q), p - first, before}:
            start = max(p - min_match, done)
            if not 0 < distance <= min(window, start) or data[start:p] != data[start - distance : p - distance]:
                continue
            while start > done and start - distance > 0 and data[start - 1] == data[start - 1 - distance]:
                start -= 1
            best = max(best, (common_length(data, start - distance, start, len(data)), -start, distance))
        length, start, distance = best[0], -best[1], best[2]
        if length >= min_match:
            out.append((start, length, distance))
            done, before = start + length, distance
    return out


def long_matches(df: DataFrame, bytes_col: str, window_log: int = 27, rate: int = 7, min_match: int = MIN_MATCH) -> DataFrame:
    """df's other columns with start, length and distance of each buffer's long matches. window_log 0, or 31 and more: no limit of distance."""
    rest = [c for c in df.columns if c not in {bytes_col, "bytes_", "start", "length", "distance"}]
    window = 1 << window_log if 0 < window_log < 31 else 1 << 62

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 256):
                b = whole.slice(i, 256)
                found = [(k, *m) for k, x in enumerate(b.column("bytes_").to_pylist()) for m in matches_of(x or b"", window, rate, min_match)]
                take, *cols = (pa.array(c, pa.int64()) for c in (zip(*found, strict=True) if found else [()] * 4))
                names = [c for c in b.schema.names if c != "bytes_"]
                yield pa.RecordBatch.from_arrays([*(b.column(c).take(take) for c in names), *cols], names=[*names, "start", "length", "distance"])

    schema = df.select(*rest).schema.add("start", "long").add("length", "long").add("distance", "long")
    return df.select(*rest, F.col(bytes_col).cast("binary").alias("bytes_")).mapInArrow(run, schema)
