"""Frames of the historic versions 0.1 to 0.7 in plain Python; no library at hand for Python reads them.

Versions 0.6 and 0.7 have the blocks of operators.decoder. The older ones code each of a sequence's three numbers as one symbol. A length that does not fit goes on in a
side list of bytes, and one past offset can be repeated. They differ among each other in these points:

- 0.1: big-endian magic; literals have a block header of their own, and four streams that take turns byte by byte.
- up to 0.4: literals have their kind in the low bits; the number of sequences takes two bytes; a table's kinds are 1 flat, 2 one symbol, else coded.
- 0.5: literals as in 0.6; a short number of sequences; kinds 0 flat, 1 one symbol, 3 coded; offsets are read before a literal length's state moves on, and no state moves after the last
  sequence.
- the repeated offset begins at 4 in 0.3 and 0.4, else at 1; from 0.4 on a repeat after literals leaves the one before it in place.
"""

from __future__ import annotations

import xxhash

from framequarry.functions.frames import BLOCK_MAX
from framequarry.operators.decoder import Bits, State, copy_match, decode_block, plain_literals, read_counts, read_stream, read_streams, read_tree, state_table
from framequarry.operators.walk import FrameError, legacy_blocks, legacy_header, legacy_of

MIN_MATCH = 4
#: Bits of a flat table and largest log of a coded one, for literal lengths, offsets and match lengths.
FIELDS = ((6, 10), (5, 9), (7, 10))
#: Codes from which a length goes on in the side list.
LAST_LITERALS, LAST_MATCH = 63, 127


def _weights(b: bytes) -> list[int]:
    """Two states take turns until the stream is used up and both are back at zero."""
    counts, log, used = read_counts(b, 255, 12)
    table, bits = state_table(counts, log), Bits(b[used:])
    states, out, k = [bits.read(log), bits.read(log)], [], 0
    while bits.left or states[k]:
        if bits.left < 0 or len(out) > 254:
            raise FrameError("Corruption")
        symbol, n, base = table[states[k]]
        out.append(symbol)
        states[k] = base + bits.read(n)
        k = 1 - k
    if any(states):
        raise FrameError("Corruption")
    return out


def _coded_literals(b: bytes, n: int, single: bool) -> bytes:
    if not n or len(b) > n or n > BLOCK_MAX:
        raise FrameError("Corruption")
    if len(b) == n:
        return b
    if len(b) == 1:
        return b * n
    tree = read_tree(b, True, _weights)
    return read_streams(b[tree[2] :], tree, n, single)


def _turning_literals(b: bytes) -> tuple[bytes, int]:
    """Version 0.1: sixteen bytes a round, from four streams in turn; what is left comes from the first stream."""
    v = int.from_bytes(b[:3], "big")
    kind, size = v >> 22, v & 0x7FFFF
    if kind in (1, 2):
        return plain_literals(b, 3, size, kind == 2)
    end = 3 + size
    if kind == 3 or end > len(b) or size < 2:
        raise FrameError("Corruption")
    n = (b[0] >> 3 & 7) << 16 | b[3] << 8 | b[4]
    rounds, rest = divmod(n, 16)
    tree = read_tree(b[5:end], True, _weights)
    body = b[5 + tree[2] : end]
    ends = [6]
    for i in range(3):
        ends.append(ends[-1] + int.from_bytes(body[2 * i : 2 * i + 2], "little"))
    if ends[3] >= len(body) or not rounds or n > BLOCK_MAX:
        raise FrameError("Corruption")
    out = bytearray(16 * rounds)
    tail = b""
    for k, (i, j) in enumerate(zip(ends, [*ends[1:], len(body)], strict=True)):
        got = read_stream(body[i:j], tree, 4 * rounds + (0 if k else rest))
        out[k::4] = got[: 4 * rounds]
        tail = tail or got[4 * rounds :]
    return bytes(out) + tail, end


def _low_literals(b: bytes, version: int) -> tuple[bytes, int]:
    """Versions 0.2 to 0.4: the kind is in the lowest bits."""
    v, kind = int.from_bytes(b[:5], "little"), b[0] & 3
    if kind in (1, 2):
        return plain_literals(b, 3, v >> 2 & 0x3FFFFF, kind == 2)
    if kind == 3 and version == 4:
        raise FrameError("Corruption")
    end = 5 + (v >> 21)
    if end > len(b):
        raise FrameError("Corruption")
    return _coded_literals(b[5:end], v >> 2 & 0x7FFFF, False), end


def _high_literals(b: bytes) -> tuple[bytes, int]:
    """Version 0.5: the kind is in the highest bits, and the next ones give the header's width."""
    kind, form = b[0] >> 6, b[0] >> 4 & 3
    if kind > 1:
        size = max(form, 1)
        n = int.from_bytes(bytes([b[0] & (31 if size == 1 else 15)]) + b[1:size], "big")
        return plain_literals(b, size, n, kind == 3)
    if kind:
        raise FrameError("DictionaryCorrupted")
    size, width = {2: (4, 14), 3: (5, 18)}.get(form, (3, 10))
    v, mask = int.from_bytes(b[:size], "big"), (1 << width) - 1
    end = size + (v & mask)
    if end > len(b):
        raise FrameError("Corruption")
    return _coded_literals(b[size:end], v >> width & mask, form == 1), end


class _Extra:
    """The side list: what lengths beyond their last code go on with. Used up, it gives nothing."""

    def __init__(self, data: bytes, version: int):
        self.data, self.version, self.at = data, version, 0

    def _take(self, n: int) -> int:
        got = self.data[self.at : self.at + n]
        self.at += n
        return int.from_bytes(got, "little")

    def length(self, code: int, last: int) -> int:
        if code < last:
            return code
        more = self._take(1)
        if more < 255:
            return code + more
        width = 3 if self.version < 5 else 2
        if self.at + width > len(self.data):
            return code
        value = self._take(width)
        if self.version == 5:
            value = (value | (self._take(1) << 16 if value & 1 else 0)) >> 1
        return value


def _table(b: bytes, at: int, field: int, mode: int, version: int) -> tuple[list[tuple[int, int, int]], int, int]:
    flat, max_log = FIELDS[field]
    if mode == (0 if version == 5 else 1):
        return [(s, flat, 0) for s in range(1 << flat)], flat, at
    if mode == (1 if version == 5 else 2):
        if at >= len(b):
            raise FrameError("SrcSizeWrong")
        if b[at] >= 1 << flat and (version == 1 or field != 1):
            raise FrameError("Corruption")
        return [(b[at] & ((1 << flat) - 1), 0, 0)], 0, at + 1
    if version == 5 and mode == 2:
        raise FrameError("DictionaryCorrupted")
    counts, log, used = read_counts(b[at:], (1 << flat) - 1, max_log)
    return state_table(counts, log), log, at + used


def _old_block(b: bytes, version: int, out: bytearray) -> None:
    """One compressed block of version 0.1 to 0.5, appended to out."""
    if len(b) < 4:
        raise FrameError("SrcSizeWrong")
    literals, at = _turning_literals(b) if version == 1 else _high_literals(b) if version == 5 else _low_literals(b, version)
    width = 2 if version < 5 else 1
    n = int.from_bytes(b[at : at + width], "little")
    at += width
    if version == 5:
        if not n:
            out += literals
            return
        if n > 127:
            n = (n - 128 << 8) + int.from_bytes(b[at : at + 1], "little")
            at += 1
    if at + 2 > len(b):
        raise FrameError("SrcSizeWrong")
    modes = b[at]
    size = int.from_bytes(b[at + 1 : at + 3], "big") if modes & 2 else b[at + 1] | (modes & 1) << 8
    at += 3 if modes & 2 else 2
    if at + size > len(b):
        raise FrameError("SrcSizeWrong")
    extra = _Extra(b[at : at + size], version)
    at += size
    tables = []
    for field, shift in enumerate((6, 4, 2)):
        table, log, at = _table(b, at, field, modes >> shift & 3, version)
        tables.append((table, log))
    _run(Bits(b[at:]), n, tables, extra, version, literals, out)


def _run(bits: Bits, n: int, tables: list, extra: _Extra, version: int, literals: bytes, out: bytearray) -> None:
    (lt, _), (ot, _), (mt, _) = tables
    l, o, m = (bits.read(log) for _, log in tables)  # noqa: E741
    own, stored = (4, 4) if version in (3, 4) else (1, 1) if version == 5 else (0, 1)
    done, data, left = 0, bits.data, bits.left
    for i in range(n):
        # At least 65 bits, more than a sequence takes; beyond the stream's end come zeros.
        hi = left + 7 >> 3 if left > 0 else 0
        lo = hi - 9
        if lo > 0:
            have = left - 8 * lo
            x = int.from_bytes(data[lo:hi], "little") & (1 << have) - 1
        else:
            have = left if left > 0 else 0
            x = (int.from_bytes(data[:hi], "little") & (1 << have) - 1) << 64
            have += 64
        all_ = have
        ll_code, l_bits, l_base = lt[l]
        of_code, o_bits, o_base = ot[o]
        if version < 5:
            have -= l_bits
            l = l_base + (x >> have & (1 << l_bits) - 1)  # noqa: E741
            have -= o_bits
            o = o_base + (x >> have & (1 << o_bits) - 1)
        if of_code:
            have -= of_code - 1
            back = (1 << of_code - 1) + (x >> have & (1 << of_code - 1) - 1)
        else:
            back = own if ll_code else stored
        if version < 4 or of_code or not ll_code:
            stored = own
        more = version < 5 or i < n - 1 or left - (all_ - have) > 0
        if version == 5 and more:
            have -= o_bits
            o = o_base + (x >> have & (1 << o_bits) - 1)
            have -= l_bits
            l = l_base + (x >> have & (1 << l_bits) - 1)  # noqa: E741
        count = ll_code if ll_code < LAST_LITERALS else extra.length(ll_code, LAST_LITERALS)
        ml_code, m_bits, m_base = mt[m]
        if more:
            have -= m_bits
            m = m_base + (x >> have & (1 << m_bits) - 1)
        length = (ml_code if ml_code < LAST_MATCH else extra.length(ml_code, LAST_MATCH)) + MIN_MATCH
        own = back
        left -= all_ - have
        if left < 0 or done + count > len(literals):
            raise FrameError("Corruption")
        out += literals[done : done + count]
        done += count
        at = len(out) - back
        if back <= 0 or at < 0:
            raise FrameError("InvalidOffset")
        if back >= length:
            out += out[at : at + length]
        else:
            copy_match(out, b"", back, length)
    if left:
        raise FrameError("Corruption")
    out += literals[done:]


def decode_legacy(b: bytes, at: int = 0, room: int | None = None) -> tuple[bytes, int]:
    """The content of the historic frame at an offset, and the offset after it. room: the most bytes it may give, beyond which decoding stops."""
    version = legacy_of(b, at)
    if version is None:
        raise FrameError("PrefixUnknown")
    end, content, checked = legacy_header(b, at, version)
    s = State(version=version, repeats=[1, 4, 8] if version == 7 else [1, 1, 1])
    for start, kind, size, stored in legacy_blocks(b, end):
        body, end, before = b[start : start + stored], start + stored, len(s.out)
        if kind == 0 and version < 6:
            _old_block(body, version, s.out)
        elif kind == 0:
            decode_block(body, s)
        else:
            s.out += body * size if kind == 2 else body
        if len(s.out) - before > BLOCK_MAX:
            raise FrameError("Corruption")
        if room is not None and len(s.out) > room:
            raise FrameError("DstSizeTooSmall")
    out = bytes(s.out)
    if content is not None and len(out) != content:
        raise FrameError("ContentSizeMismatch")
    if checked and xxhash.xxh64_intdigest(out) >> 11 & 0x3FFFFF != int.from_bytes(b[end - 3 : end], "big") & 0x3FFFFF:
        raise FrameError("ChecksumWrong")
    return out, end
