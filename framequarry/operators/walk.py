"""Walking a buffer's frames and blocks in Python: the extents that every table function, bound and decoder here agrees on."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from framequarry.functions.frames import BLOCK_MAX, LEGACY, MAGIC, MAGIC_SKIPPABLE, SKIPPABLE_MASK, WINDOW_LOG_MAX, WINDOW_LOG_MIN

KINDS = ("raw", "rle", "compressed")


class FrameError(Exception):
    """A broken frame; str() is the error's name."""


@dataclass(frozen=True)
class Header:
    kind: str
    size: int
    window: int
    dict_id: int
    checksum: bool
    content: int | None


def _need(b: bytes, end: int) -> None:
    if end > len(b):
        raise FrameError("SrcSizeWrong")


def read_header(b: bytes, at: int = 0) -> Header:
    if at + 4 > len(b):
        raise FrameError("PrefixUnknown")
    magic = int.from_bytes(b[at : at + 4], "little")
    if magic & SKIPPABLE_MASK == MAGIC_SKIPPABLE:
        _need(b, at + 8)
        return Header("skippable", 8, 0, magic & 15, False, int.from_bytes(b[at + 4 : at + 8], "little"))
    if magic != MAGIC:
        raise FrameError("PrefixUnknown")
    _need(b, at + 5)
    flags, end = b[at + 4], at + 5
    if flags & 8:
        raise FrameError("FrameParameterUnsupported")
    single, window = bool(flags & 32), 0
    if not single:
        _need(b, end + 1)
        log = (b[end] >> 3) + WINDOW_LOG_MIN
        if log > WINDOW_LOG_MAX:
            raise FrameError("WindowTooLarge")
        window = (1 << log) + ((1 << log) >> 3) * (b[end] & 7)
        end += 1
    fields = []
    for n in ((0, 1, 2, 4)[flags & 3], (1 if single else 0, 2, 4, 8)[flags >> 6]):
        _need(b, end + n)
        fields.append((n, int.from_bytes(b[end : end + n], "little")))
        end += n
    (_, dict_id), (n, content) = fields
    content = None if n == 0 else content + 256 if n == 2 else content
    return Header("regular", end - at, content if single else window, dict_id, bool(flags & 4), content)


def read_blocks(b: bytes, at: int) -> Iterator[tuple[int, str, bool, int, int]]:
    """(offset, type, last, size, stored bytes after the header) up to the last block."""
    last = False
    while not last:
        _need(b, at + 3)
        v = int.from_bytes(b[at : at + 3], "little")
        last, kind, size = bool(v & 1), v >> 1 & 3, v >> 3
        if kind == 3:
            raise FrameError("InvalidBlock")
        stored = 1 if kind == 1 else size
        _need(b, at + 3 + stored)
        yield at, KINDS[kind], last, size, stored
        at += 3 + stored


def frame_end(b: bytes, at: int = 0) -> tuple[Header, int]:
    """The header of the frame at an offset and the offset after it."""
    h = read_header(b, at)
    if h.kind == "skippable":
        _need(b, at + 8 + h.content)
        return h, at + 8 + h.content
    end = at + h.size
    for start, _, _, _, stored in read_blocks(b, end):
        end = start + 3 + stored
    if h.checksum:
        _need(b, end + 4)
        end += 4
    return h, end


def legacy_of(b: bytes, at: int = 0) -> int | None:
    return LEGACY.get(bytes(b[at : at + 4]).hex())


def legacy_header(b: bytes, at: int, version: int) -> tuple[int, int | None, bool]:
    """(offset after the header, declared size, checksum) of the historic frame at an offset."""
    if version < 4:
        return at + 4, None, False
    _need(b, at + 5)
    flags, end = b[at + 4], at + 5
    if flags & {4: 0xF0, 5: 0xF0, 6: 0x20, 7: 0}[version]:
        raise FrameError("FrameParameterUnsupported")
    if version < 6:
        return end, None, False
    single = version == 7 and bool(flags & 32)
    if version == 7:
        end += (0 if single else 1) + (0, 1, 2, 4)[flags & 3]
    n = (1 if single else 0, 2, 4, 8)[flags >> 6] if version == 7 else (0, 1, 2, 8)[flags >> 6]
    _need(b, end + n)
    content = int.from_bytes(b[end : end + n], "little") + (256 if n == 2 else 0) if n else None
    return end + n, content, version == 7 and bool(flags & 4)


def legacy_blocks(b: bytes, at: int) -> Iterator[tuple[int, int, int, int]]:
    """(offset of the body, type, size, stored bytes) up to and with the end block of a historic frame; type 0 is compressed, 1 raw, 2 rle, 3 the end."""
    kind = 0
    while kind != 3:
        _need(b, at + 3)
        v = int.from_bytes(b[at : at + 3], "big")
        kind, size = v >> 22, v & 0x7FFFF
        at += 3
        stored = (size, size, 1, 0)[kind]
        _need(b, at + stored)
        yield at, kind, size, stored
        at += stored


def legacy_end(b: bytes, at: int, version: int) -> int:
    """The offset after the historic frame at an offset."""
    end, _, _ = legacy_header(b, at, version)
    for start, _, _, stored in legacy_blocks(b, end):
        end = start + stored
    return end


def walk(b: bytes) -> Iterator[tuple[int, Header, int]]:
    """(offset, header, end) of each frame; a historic or unknown one raises InvalidMagic, a cut-off one SrcSizeWrong."""
    at = 0
    while at < len(b):
        _need(b, at + 4)
        try:
            h, end = frame_end(b, at)
        except FrameError as e:
            raise FrameError("InvalidMagic") from e if str(e) == "PrefixUnknown" else e
        yield at, h, end
        at = end


#: A historic frame counts as this many bytes in a bound.
LEGACY_BOUND = 1 << 20


def bound(b: bytes) -> int:
    """The most bytes that the frames can give: declared sizes, else the blocks' (a compressed one counts as 128 KiB); LEGACY_BOUND for a historic frame."""
    total = at = 0
    while at < len(b):
        _need(b, at + 4)
        version = legacy_of(b, at)
        if version:
            total, at = total + LEGACY_BOUND, legacy_end(b, at, version)
            continue
        try:
            h, end = frame_end(b, at)
        except FrameError as e:
            raise FrameError("InvalidMagic") from e if str(e) == "PrefixUnknown" else e
        if h.kind == "regular":
            total += h.content if h.content is not None else sum(BLOCK_MAX if kind == "compressed" else size for _, kind, _, size, _ in read_blocks(b, at + h.size))
        at = end
    return total
