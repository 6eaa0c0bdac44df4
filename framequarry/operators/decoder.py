"""A decoder in plain Python: RFC 8878 frames, and the blocks of the historic versions 0.6 and 0.7.

It is the second opinion that tests hold the codec library against. Versions 0.6 and 0.7 share the entropy coding with the present format and differ in mode numbers and
repeat offsets; their frames, and all that is older, are in operators.historic.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import xxhash

from framequarry.functions.frames import BLOCK_MAX
from framequarry.functions.parameters import LL_BASE, ML_BASE
from framequarry.operators.hashes import XXH64
from framequarry.operators.walk import FrameError, legacy_of, read_blocks, read_header

# Extra bits and default distributions of the three codes.
LL_BITS = (0,) * 16 + (1, 1, 1, 1, 2, 2, 3, 3, 4, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15, 16)
ML_BITS = (0,) * 32 + (1, 1, 1, 1, 2, 2, 3, 3, 4, 4, 5, 7, 8, 9, 10, 11, 12, 13, 14, 15, 16)
LL_NORM = (4, 3, 2, 2, 2, 2, 2, 2, 2, 2, 2, 2, 2, 1, 1, 1, 2, 2, 2, 2, 2, 2, 2, 2, 2, 3, 2, 1, 1, 1, 1, 1, -1, -1, -1, -1)
ML_NORM = (1, 4, 3, 2, 2, 2, 2, 2, 2) + (1,) * 37 + (-1,) * 7
OF_NORM = (1, 1, 1, 1, 1, 1, 2, 2, 2) + (1,) * 15 + (-1,) * 5
#: Weights of a run-length tree description of the historic versions, by its first byte less 242.
OLD_RUNS = (1, 2, 3, 4, 7, 8, 15, 16, 31, 32, 63, 64, 127, 128)


class Bits:
    """A stream that is read from its end; its last set bit marks where it begins."""

    def __init__(self, data: bytes):
        if not data or not data[-1]:
            raise FrameError("Corruption")
        self.data = data
        self.left = 8 * (len(data) - 1) + data[-1].bit_length() - 1

    def peek(self, n: int) -> int:
        """The next n bits; zeros come after the stream's end."""
        low = self.left - n
        short = -low if low < 0 else 0
        first = max(low, 0)
        got = int.from_bytes(self.data[first >> 3 : (self.left + 7) >> 3], "little") >> (first & 7)
        return (got & ((1 << (n - short)) - 1)) << short if n > short else 0

    def read(self, n: int) -> int:
        if not n:
            return 0
        out = self.peek(n)
        self.left -= n
        return out


def read_counts(b: bytes, max_symbol: int, max_log: int) -> tuple[list[int], int, int]:
    """Normalised counts, their log and the bytes they took."""
    value, at = int.from_bytes(b[:512], "little"), 4
    log = (value & 15) + 5
    if not b or log > max_log:
        raise FrameError("TableLogTooLarge" if b else "SrcSizeWrong")
    left, counts = 1 << log, []
    while left > 0:
        if len(counts) > max_symbol:
            raise FrameError("Corruption")
        width = (left + 1).bit_length()
        spare = (1 << width) - 2 - left  # values that need one bit less
        v = value >> at & ((1 << width) - 1)
        short = v & ((1 << (width - 1)) - 1)
        if short < spare:
            v, at = short, at + width - 1
        else:
            v, at = v - spare if v >= 1 << (width - 1) else v, at + width
        counts.append(v - 1)
        left -= abs(v - 1)
        if v == 1:
            while True:
                zeros = value >> at & 3
                at += 2
                counts += [0] * zeros
                if zeros < 3:
                    break
    used = (at + 7) // 8
    if left < 0 or used > len(b) or len(counts) > max_symbol + 1:
        raise FrameError("Corruption")
    return counts, log, used


def state_table(counts, log: int) -> list[tuple[int, int, int]]:
    """(symbol, bits to read, base of the next state) for each state."""
    size = 1 << log
    symbols, top = [0] * size, size - 1
    for s, n in enumerate(counts):
        if n == -1:
            symbols[top] = s
            top -= 1
    at, step = 0, (size >> 1) + (size >> 3) + 3
    for s, n in enumerate(counts):
        for _ in range(max(n, 0)):
            symbols[at] = s
            at = (at + step) % size
            while at > top:
                at = (at + step) % size
    if at:
        raise FrameError("Corruption")
    seen, out = [abs(n) for n in counts], []
    for s in symbols:
        x = seen[s]
        seen[s] += 1
        bits = log - x.bit_length() + 1
        out.append((s, bits, (x << bits) - size))
    return out


def _weights(b: bytes) -> list[int]:
    """Two states take turns until the stream is used up."""
    counts, log, used = read_counts(b, 255, 6)
    table, bits = state_table(counts, log), Bits(b[used:])
    states, out, k = [bits.read(log), bits.read(log)], [], 0
    if bits.left < 0:
        raise FrameError("Corruption")
    while len(out) < 255:
        symbol, n, base = table[states[k]]
        out.append(symbol)
        if bits.left < n:
            out.append(table[states[1 - k]][0])
            return out
        states[k] = base + bits.read(n)
        k = 1 - k
    raise FrameError("Corruption")


def read_tree(b: bytes, old: bool = False, coded: Callable[[bytes], list[int]] = _weights) -> tuple[list[tuple[int, int]], int, int]:
    """A prefix code as (symbol, bits) for each value of its longest code, that length, and the bytes it took."""
    if not b:
        raise FrameError("SrcSizeWrong")
    head = b[0]
    if old and head >= 242:
        weights, used = [1] * OLD_RUNS[head - 242], 1
    elif head >= 128:
        n = head - 127
        used = 1 + (n + 1) // 2
        weights = [b[1 + i // 2] >> (0 if i & 1 else 4) & 15 for i in range(n)] if used <= len(b) else []
    else:
        used = 1 + head
        weights = coded(b[1:used]) if head and used <= len(b) else []
    total = sum(1 << w >> 1 for w in weights)
    if not total:
        raise FrameError("Corruption")
    depth = total.bit_length()
    rest = (1 << depth) - total
    if depth > 12 or rest & (rest - 1) or max(weights) > depth or len(weights) > 255:
        raise FrameError("Corruption")
    weights = [*weights, rest.bit_length()]
    table = []
    for w in range(1, depth + 1):
        for s, x in enumerate(weights):
            if x == w:
                table += [(s, depth + 1 - w)] * (1 << w >> 1)
    return table, depth, used


def read_stream(b: bytes, tree, n: int) -> bytes:
    table, depth, _ = tree
    bits, out = Bits(b), bytearray()
    while len(out) < n:
        symbol, used = table[bits.peek(depth)]
        bits.left -= used
        out.append(symbol)
    if bits.left:
        raise FrameError("Corruption")
    return bytes(out)


def read_streams(b: bytes, tree, n: int, single: bool) -> bytes:
    if single:
        return read_stream(b, tree, n)
    ends = [6]
    for i in range(3):
        ends.append(ends[-1] + int.from_bytes(b[2 * i : 2 * i + 2], "little"))
    part = (n + 3) // 4
    if ends[3] >= len(b) or 3 * part > n:
        raise FrameError("Corruption")
    sizes = (part, part, part, n - 3 * part)
    return b"".join(read_stream(b[i:j], tree, k) for i, j, k in zip(ends, [*ends[1:], len(b)], sizes, strict=True))


@dataclass
class State:
    """What blocks of a frame pass on: output so far, the tree, tables and repeat offsets."""

    out: bytearray = field(default_factory=bytearray)
    tree: tuple | None = None
    tables: dict = field(default_factory=dict)
    repeats: list[int] = field(default_factory=lambda: [1, 4, 8])
    version: int = 8
    window: int = 1 << 31


def plain_literals(b: bytes, at: int, n: int, run: bool) -> tuple[bytes, int]:
    end = at + (1 if run else n)
    if end > len(b):
        raise FrameError("SrcSizeWrong")
    return b[at:end] * n if run else b[at:end], end


def _literals(b: bytes, s: State) -> tuple[bytes, int]:
    head = b[0] if b else 0
    if s.version < 8:
        kind, form = head >> 6, head >> 4 & 3
        if kind >= 2:
            size = {2: 2, 3: 3}.get(form, 1)
            n = int.from_bytes(bytes([head & (31 if size == 1 else 15)]) + b[1:size], "big")
            return plain_literals(b, size, n, kind == 3)
        if kind == 1 and form != 1:
            raise FrameError("Corruption")
        size, width = (3, 10) if form < 2 else (4, 14) if form == 2 else (5, 18)
        v = int.from_bytes(b[:size], "big")
        n, stored, single, repeat = v >> width & ((1 << width) - 1), v & ((1 << width) - 1), form == 1, kind == 1
        n &= (1 << width) - 1
    else:
        kind, form = head & 3, head >> 2 & 3
        if kind < 2:
            size = {1: 2, 3: 3}.get(form, 1)
            v = int.from_bytes(b[:size], "little")
            return plain_literals(b, size, v >> (3 if size == 1 else 4), kind == 1)
        size, width = (3, 10) if form < 2 else (4, 14) if form == 2 else (5, 18)
        v = int.from_bytes(b[:size], "little") >> 4
        n, stored, single, repeat = v & ((1 << width) - 1), v >> width, form == 0, kind == 3
    end = size + stored
    if end > len(b) or n > BLOCK_MAX:
        raise FrameError("Corruption")
    used = 0
    if not repeat:
        s.tree = read_tree(b[size:end], s.version < 8)
        used = s.tree[2]
    elif s.tree is None:
        raise FrameError("DictionaryCorrupted")
    return read_streams(b[size + used : end], s.tree, n, single), end


_CODES = (("ll", LL_NORM, 6, 35, 9), ("of", OF_NORM, 5, 31, 8), ("ml", ML_NORM, 6, 52, 9))


def _tables(b: bytes, at: int, s: State) -> int:
    """Reads the mode byte and the tables it asks for."""
    modes = b[at]
    at += 1
    coded, repeat = (2, 3) if s.version > 7 else (3, 2)
    for (name, norm, log, top, max_log), mode in zip(_CODES, (modes >> 6, modes >> 4 & 3, modes >> 2 & 3), strict=True):
        if mode == 0:
            s.tables[name] = state_table(norm, log), log
        elif mode == 1:
            if at >= len(b) or b[at] > top:
                raise FrameError("Corruption")
            s.tables[name] = [(b[at], 0, 0)], 0
            at += 1
        elif mode == coded:
            counts, log, used = read_counts(b[at:], top, max_log)
            s.tables[name] = state_table(counts, log), log
            at += used
        elif mode == repeat and name not in s.tables:
            raise FrameError("Corruption")
    return at


def _distance(code: int, extra: int, literals: int, s: State) -> int:
    """The offset of a sequence, moved to the front of the repeats."""
    r = s.repeats
    value = (1 << code) + extra
    if s.version > 7:
        if value > 3:
            r[:] = [value - 3, r[0], r[1]]
            return value - 3
        k = value - (0 if not literals else 1)
        if k == 3:
            r[:] = [r[0] - 1, r[0], r[1]]
        elif k:
            r.insert(0, r.pop(k))
        return r[0]
    value -= 1
    if value > 2:
        r[:] = [value - 2, r[0], r[1]]
        return value - 2
    k = 1 - value if not literals and value < 2 else value
    if k:
        r.insert(0, r.pop(k))
    return r[0]


def decode_block(b: bytes, s: State, history: bytes = b"") -> None:
    """One compressed block, appended to the state's output."""
    literals, at = _literals(b, s)
    if at >= len(b):
        raise FrameError("SrcSizeWrong")
    n = b[at]
    at += 1
    if n > 127:
        take = 2 if n == 255 else 1
        n = int.from_bytes(b[at : at + 2], "little") + 0x7F00 if n == 255 else (n - 128 << 8) + b[at]
        at += take
    if not n:
        if at != len(b):
            raise FrameError("Corruption")
        s.out += literals
        return
    if s.version > 7 and b[at] & 3:
        raise FrameError("Corruption")
    at = _tables(b, at, s)
    bits, done, out = Bits(b[at:]), 0, s.out
    (lt, ln), (ot, on), (mt, mn) = (s.tables[k] for k in ("ll", "of", "ml"))
    l, o, m = bits.read(ln), bits.read(on), bits.read(mn)  # noqa: E741
    for i in range(n):
        of_code, (ml_code, ll_code) = ot[o][0], (mt[m][0], lt[l][0])
        extra = bits.read(of_code)
        length = ML_BASE[ml_code] + bits.read(ML_BITS[ml_code])
        count = LL_BASE[ll_code] + bits.read(LL_BITS[ll_code])
        back = _distance(of_code, extra, ll_code if s.version < 8 else count, s)
        if i < n - 1:
            l = lt[l][2] + bits.read(lt[l][1])  # noqa: E741
            m = mt[m][2] + bits.read(mt[m][1])
            o = ot[o][2] + bits.read(ot[o][1])
        if bits.left < 0 or done + count > len(literals):
            raise FrameError("Corruption")
        out += literals[done : done + count]
        done += count
        if back <= 0 or back > len(out) + len(history):
            raise FrameError("InvalidOffset")
        if back > max(s.window, BLOCK_MAX) and back <= len(out):
            raise FrameError("Corruption")
        copy_match(out, history, back, length)
    if bits.left:
        raise FrameError("Corruption")
    out += literals[done:]


class StreamDecoder:
    """Frames that arrive in pieces: blocks leave as soon as they are whole. Only plain values are held: the bytes that no block has taken, the window, tables and the checksum's state."""

    def __init__(self, max_window: int = 1 << 27, ignore_checksum: bool = False, whole: Callable[[bytes], tuple[bytes, int] | None] | None = None):
        """whole: decodes the frame at the start of some bytes if it is there whole and of a kind of its own; gives its content and size, or None to go on by blocks."""
        self.max_window, self.ignore_checksum, self.whole = max_window, ignore_checksum, whole
        self.rest, self.skip, self.header, self.ended = b"", 0, None, False

    @property
    def idle(self) -> bool:
        """Whether no frame is open."""
        return not self.rest and not self.skip and self.header is None

    def feed(self, data: bytes) -> bytes:
        self.rest += data
        out = []
        while self.rest:
            if self.skip:
                n = min(self.skip, len(self.rest))
                self.rest, self.skip = self.rest[n:], self.skip - n
                continue
            got = self._block() if self.header else self._head()
            if got is None:
                break
            out.append(got)
        return b"".join(out)

    def _head(self) -> bytes | None:
        if len(self.rest) < 4:
            return None
        got = self.whole(self.rest) if self.whole else None
        if got:
            self.rest = self.rest[got[1] :]
            return got[0]
        try:
            h = read_header(self.rest)
        except FrameError as e:
            if str(e) == "SrcSizeWrong" or str(e) == "PrefixUnknown" and legacy_of(self.rest):
                return None
            raise
        if h.kind == "skippable":
            self.rest, self.skip = self.rest[8:], h.content
            return b""
        if h.window > self.max_window:
            raise FrameError("WindowTooLarge")
        self.header, self.rest, self.made, self.ended = h, self.rest[h.size :], 0, False
        self.state, self.hash = State(window=h.window), XXH64()
        return b""

    def _block(self) -> bytes | None:
        if self.ended:
            if len(self.rest) < 4:
                return None
            if not self.ignore_checksum and self.hash.digest() & 0xFFFFFFFF != int.from_bytes(self.rest[:4], "little"):
                raise FrameError("ChecksumWrong")
            self.rest, self.header = self.rest[4:], None
            return b""
        try:
            _, kind, last, size, stored = next(read_blocks(self.rest, 0))
        except FrameError as e:
            if str(e) == "SrcSizeWrong":
                return None
            raise
        s, before = self.state, len(self.state.out)
        add_block(s, kind, size, self.rest[3 : 3 + stored])
        got, self.rest = bytes(s.out[before:]), self.rest[3 + stored :]
        self.made += len(got)
        del s.out[: max(0, len(s.out) - max(self.header.window, BLOCK_MAX))]
        if self.header.checksum and not self.ignore_checksum:
            self.hash.update(got)
        if last:
            if self.header.content is not None and self.made != self.header.content:
                raise FrameError("ContentSizeMismatch")
            self.ended = True
            if not self.header.checksum:
                self.header = None
        return got


def copy_match(out: bytearray, history: bytes, back: int, length: int) -> None:
    before = back - len(out)
    if before > 0:
        got = history[len(history) - before :][:length]
        out += got
        length -= len(got)
    while length > 0:
        part = out[-back:][:length] if back < length else out[len(out) - back : len(out) - back + length]
        out += part
        length -= len(part)


def add_block(s: State, kind: str, size: int, body: bytes, dictionary: bytes = b"", room: int | None = None) -> None:
    """A block of any kind, appended to the state's output; DstSizeTooSmall if it gives more than `room` bytes."""
    begin = len(s.out)
    if room is not None and kind != "compressed" and size > room:
        raise FrameError("DstSizeTooSmall")
    if kind == "compressed":
        decode_block(body, s, dictionary)
        if len(s.out) - begin > BLOCK_MAX:
            raise FrameError("Corruption")
        if room is not None and len(s.out) - begin > room:
            raise FrameError("DstSizeTooSmall")
    else:
        s.out += body * size if kind == "rle" else body


def decode_regular(frame: bytes, dictionary: bytes = b"", room: int | None = None, state: State | None = None) -> bytes:
    """One whole RFC 8878 frame. room: the most bytes it may give, beyond which decoding stops; state: what a prepared dictionary lends the first block."""
    h = read_header(frame)
    s = state or State()
    s.window = h.window
    if room is not None and h.content is not None and h.content > room:
        raise FrameError("DstSizeTooSmall")
    for at, kind, _, size, stored in read_blocks(frame, h.size):
        add_block(s, kind, size, frame[at + 3 : at + 3 + stored], dictionary, None if room is None else room - len(s.out))
    if h.content is not None and len(s.out) != h.content:
        raise FrameError("ContentSizeMismatch")
    if h.checksum and xxhash.xxh64_intdigest(bytes(s.out)) & 0xFFFFFFFF != int.from_bytes(frame[-4:], "little"):
        raise FrameError("ChecksumWrong")
    return bytes(s.out)
