"""Ogg media columns: pages, checksums, lacing, logical streams and granule positions (RFC 3533).

Payloads are 8-bit samples. A writer cuts them into packets, deals the packets in turn to logical streams and interleaves the streams' pages. The reader
verifies each page's checksum, sequence and flags, puts packets together from lacing values, separates the streams and derives each packet's time from granule positions.
Both work on one row at a time inside an Arrow batch, so nothing is shuffled.

Defined cases: a null value is read as an empty one; a value of any length that Spark holds is written whole, as more packets and pages; broken bytes give what could be read, with the faults counted by name; repeated rows give equal results; further
columns stay, columns with the result's names are replaced; an empty table gives an empty result.
"""

from __future__ import annotations

import struct
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framequarry.llm._words import slices

CAPTURE = b"OggS"
_HEADER = struct.Struct("<4sBBqIIIB")
CONTINUED, FIRST, LAST = 1, 2, 4
_IDENT = struct.Struct("<8sIIBBQ")
_MAGIC = b"8bitPCM\0"
_REVERSED = bytes(int(f"{i:08b}"[::-1], 2) for i in range(256))
#: Samples a second, samples in a packet, segments in a page.
RATE, PACKET, SEGMENTS = 8000, 1000, 64


def page_checksum(page: bytes) -> int:
    """The CRC-32 of Ogg: polynomial 04C11DB7, no reflection, start and end at 0. It is zlib's over bit-reversed bytes, bit-reversed."""
    crc = zlib.crc32(page.translate(_REVERSED), 0xFFFFFFFF) ^ 0xFFFFFFFF
    return int.from_bytes(crc.to_bytes(4, "little").translate(_REVERSED), "big")


def _page(flags: int, granule: int, serial: int, sequence: int, lacing: bytes, body: bytes) -> bytes:
    head = _HEADER.pack(CAPTURE, 0, flags, granule, serial, sequence, 0, len(lacing)) + lacing
    return head[:22] + struct.pack("<I", page_checksum(head + body)) + head[26:] + body


def _lacing(n: int) -> bytes:
    return b"\xff" * (n // 255) + bytes([n % 255])


def _stream_pages(serial: int, ident: bytes, packets: list[bytes]) -> Iterator[tuple[int, bytes]]:
    """(samples before it, page) of one logical stream. Packets run over page ends where the segments do."""
    yield -1, _page(FIRST | (0 if packets else LAST), 0, serial, 0, _lacing(len(ident)), ident)
    laces = b"".join(_lacing(len(p)) for p in packets)
    body, done, at, sequence = b"".join(packets), 0, 0, 1
    sizes = iter(packets)
    for i in range(0, len(laces), SEGMENTS):
        lacing = laces[i : i + SEGMENTS]
        n, before, ended = sum(lacing), done, False
        for x in lacing:
            if x < 255:
                done += len(next(sizes))
                ended = True
        flags = (CONTINUED if i and laces[i - 1] == 255 else 0) | (LAST if i + SEGMENTS >= len(laces) else 0)
        yield before, _page(flags, done if ended else -1, serial, sequence, lacing, body[at : at + n])
        at, sequence = at + n, sequence + 1


def write_ogg(payload: bytes, streams: int = 2) -> bytes:
    """8-bit samples as an Ogg file of `streams` multiplexed logical streams, whose serial numbers follow from the payload."""
    packets = [payload[i : i + PACKET] for i in range(0, len(payload), PACKET)]
    seed, pages = zlib.crc32(payload), []
    for k in range(streams):
        ident = _IDENT.pack(_MAGIC, RATE, PACKET, k, streams, len(payload))
        pages += [(t, k, j, p) for j, (t, p) in enumerate(_stream_pages((seed + k) & 0xFFFFFFFF, ident, packets[k::streams]))]
    return b"".join(p for *_, p in sorted(pages, key=lambda x: x[:3]))


@dataclass
class Logical:
    """One logical stream as it is read: its packets with their first sample and the granule position that closed them."""

    serial: int
    packets: list[bytes] = field(default_factory=list)
    starts: list[int] = field(default_factory=list)
    next_page: int = 0
    granule: int = 0
    pages: int = 0
    ended: bool = False
    open_: list[bytes] | None = None
    samples: int = 0


def read_ogg(media: bytes) -> tuple[list[Logical], Counter]:
    """The logical streams in the order of their first pages, and the faults found. Bytes between pages are skipped to the next capture pattern."""
    streams: dict[int, Logical] = {}
    faults: Counter = Counter()
    at = 0
    while (found := media.find(CAPTURE, at)) >= 0:
        if found > at:
            faults["skipped_bytes"] += found - at
        if found + 27 > len(media):
            break
        _, version, flags, granule, serial, sequence, checksum, n = _HEADER.unpack_from(media, found)
        lacing = media[found + 27 : found + 27 + n]
        end = found + 27 + n + sum(lacing)
        if len(lacing) < n or end > len(media):
            faults["truncated"] += 1
            at = found + 4
            continue
        page = media[found:end]
        if version or page_checksum(page[:22] + b"\0\0\0\0" + page[26:]) != checksum:
            faults["bad_checksum"] += 1
            at = found + 4
            continue
        at = end
        s = streams.get(serial)
        if s is None:
            s = streams[serial] = Logical(serial)
            if not flags & FIRST:
                faults["no_first_page"] += 1
        if sequence != s.next_page:
            faults["lost_pages"] += 1
            s.open_ = None
        _add_page(s, flags, granule, lacing, page[27 + n :], faults)
        s.next_page = sequence + 1
    if at < len(media):
        faults["skipped_bytes"] += len(media) - at
    for s in streams.values():
        if not s.ended or s.open_:
            faults["unended"] += 1
    return list(streams.values()), faults


def _add_page(s: Logical, flags: int, granule: int, lacing: bytes, body: bytes, faults: Counter) -> None:
    s.pages += 1
    whole = bool(flags & CONTINUED) == (s.open_ is not None)
    if not whole:
        faults["broken_packet"] += 1
    parts = s.open_ if flags & CONTINUED and s.open_ is not None else None if flags & CONTINUED else []
    at, closed = 0, []
    for x in lacing:
        if parts is not None:
            parts.append(body[at : at + x])
        at += x
        if x < 255:
            if parts is not None:
                closed.append(b"".join(parts))
            parts = []
    s.open_ = parts if lacing and lacing[-1] == 255 else None
    if closed and not flags & FIRST:  # the page's granule position is the end of the last packet that it completes
        start = granule - sum(map(len, closed))
        if start != s.granule:
            faults["granule_gap"] += 1
        for p in closed:
            s.starts.append(start)
            start += len(p)
        s.granule = granule
    elif closed:
        s.starts += [0] * len(closed)
    s.packets += closed
    s.ended |= bool(flags & LAST)


def payload_of(streams: list[Logical]) -> bytes:
    """The samples of a file from write_ogg, its streams' packets put in turn again by their first samples."""
    parts: list[tuple[int, int, bytes]] = []
    for s in streams:
        if s.packets and s.packets[0][:8] == _MAGIC:
            _, _, size, k, n, total = _IDENT.unpack(s.packets[0])
            parts += [(start // size * n + k, start, p) for start, p in zip(s.starts[1:], s.packets[1:], strict=True)]
    return b"".join(p for *_, p in sorted(parts, key=lambda x: x[0]))


def feature(streams: list[Logical], faults: Counter) -> str:
    """What the pages say: streams, pages, packets, each stream's length in milliseconds by its granule position, and the last packet's time."""
    times = [s.granule * 1000 // RATE for s in streams]
    last = max((s.starts[-1] * 1000 // RATE for s in streams if len(s.packets) > 1), default=0)
    return (
        f"streams={len(streams)};pages={sum(s.pages for s in streams)};packets={sum(len(s.packets) for s in streams)};"
        f"ms={','.join(map(str, times))};last_packet_ms={last};faults={sum(faults.values())}"
    )


def _encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        names = [c for c in b.schema.names if c != "payload_"]
        media = [write_ogg(x or b"") for x in b.column("payload_").to_pylist()]
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(media, pa.binary())], names=[*names, "media"])


def to_ogg(df: DataFrame, payload_col: str) -> DataFrame:
    """df without its payload column, with `media`, the samples as Ogg bytes."""
    rest = [c for c in df.columns if c not in {payload_col, "media", "payload_"}]
    rows = df.select(*rest, F.col(payload_col).alias("payload_"))
    return rows.mapInArrow(_encode, df.select(*rest).schema.add("media", "binary"))


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        payload, features, faulty = [], [], []
        for x in b.column("media").to_pylist():
            streams, faults = read_ogg(x or b"")
            payload.append(payload_of(streams))
            features.append(feature(streams, faults))
            faulty.append(",".join(f"{k}:{v}" for k, v in sorted(faults.items())))
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(payload, pa.binary()), pa.array(features, pa.string()), pa.array(faulty, pa.string())], names=[*b.schema.names, "payload", "feature", "faults"])


def from_ogg(df: DataFrame, media_col: str = "media") -> DataFrame:
    """df with payload (binary), feature and faults (empty: none) as read back from the Ogg bytes."""
    rest = [c for c in df.columns if c not in {media_col, "media", "payload", "feature", "faults"}]
    rows = df.select(*rest, F.col(media_col).alias("media"))
    schema = rows.select("*").schema.add("payload", "binary").add("feature", "string").add("faults", "string")
    return rows.mapInArrow(_decode, schema)


def _packet_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, 128):
        at, rows = [], []
        for i, x in enumerate(b.column("media").to_pylist()):
            for s in read_ogg(x or b"")[0]:
                for j, (start, p) in enumerate(zip(s.starts, s.packets, strict=True)):
                    at.append(i)
                    rows.append((s.serial, j, start, start * 1000 // RATE, p))
        cols = list(zip(*rows, strict=True)) or [()] * 5
        kinds = [pa.int64()] * 4 + [pa.binary()]
        names = [c for c in b.schema.names if c != "media"]
        take = pa.array(at, pa.int64())
        yield pa.RecordBatch.from_arrays([*(b.column(c).take(take) for c in names), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], names=[*names, *_PACKET_NAMES])


_PACKET_NAMES = ["serial", "packet_no", "start_sample", "start_ms", "packet"]


def ogg_packets(df: DataFrame, media_col: str = "media") -> DataFrame:
    """One row per packet of each logical stream: df's other columns, serial, packet_no, start_sample, start_ms, packet."""
    rest = [c for c in df.columns if c not in {media_col, "media", *_PACKET_NAMES}]
    schema = df.select(*rest).schema
    for name in _PACKET_NAMES[:4]:
        schema = schema.add(name, "long")
    return df.select(*rest, F.col(media_col).alias("media")).mapInArrow(_packet_rows, schema.add("packet", "binary"))
