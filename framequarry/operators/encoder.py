"""An encoder in plain Python and numpy: RFC 8878 blocks and frames.

It exists for what a codec library keeps to itself: its whole state is a few plain values, so a stream's frame can go on in the next micro-batch, and jobs on several executors can
write blocks of one frame. It runs at one or two MB a second and core; single buffers are better left to the library.

1. Candidates: for each position the nearest earlier ones that share its next 4 bytes (also its next 8 and 16 for the stronger strategies), all found at once by stable sorts.
2. Parsing: greedy, lazy (a match may wait for a longer one one or two bytes later), or by least cost, backwards over the block.
3. Literals: raw, run, or a prefix code of at most 11 bits, in one stream or four; the block before may lend its code.
4. Sequences: codes by the default tables, one symbol, or tables of their own, whichever is the least.

A block that does not shrink is stored raw or as a run, and leaves the state as it was.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cache

import numpy as np
import xxhash

from framequarry.functions.frames import BLOCK_MAX, MAGIC
from framequarry.functions.parameters import LL_BASE, ML_BASE, STRATEGIES
from framequarry.operators.decoder import LL_BITS, LL_NORM, ML_BITS, ML_NORM, OF_NORM
from framequarry.operators.hashes import XXH64
from framequarry.operators.stats import CODE_DEPTH, code_lengths, normalized

MIN_MATCH = 4
#: The longest match that is looked for. A longer one is written as several.
MAX_MATCH = 4096
#: Candidates that are tried at a position, and how many bytes the parser looks ahead; None: by least cost.
EFFORT = {"fast": (1, 0), "dfast": (2, 0), "greedy": (4, 0), "lazy": (6, 1), "lazy2": (12, 2), "btlazy2": (16, 2), "btopt": (8, None), "btultra": (16, None), "btultra2": (32, None)}


# Bits


def packed(values: np.ndarray, widths: np.ndarray) -> bytes:
    """A stream that is read from its end: the given fields in the order of reading, then the bit that marks its beginning."""
    v = np.concatenate([values[::-1], [1]]).astype(np.uint64)
    w = np.concatenate([widths[::-1], [1]]).astype(np.int64)
    at = np.concatenate([[0], np.cumsum(w)])
    word, shift = at[:-1] >> 6, (at[:-1] & 63).astype(np.uint64)
    out = np.zeros((int(at[-1]) >> 6) + 2, np.uint64)
    np.bitwise_or.at(out, word, v << shift)
    spill = np.flatnonzero(shift + w.astype(np.uint64) > 64)
    np.bitwise_or.at(out, word[spill] + 1, v[spill] >> (np.uint64(64) - shift[spill]))
    return out.astype("<u8").tobytes()[: (int(at[-1]) + 7) // 8]


def write_counts(counts: list[int], log: int) -> bytes:
    """Normalised counts as a table description."""
    value, at, left, i = log - 5, 4, 1 << log, 0
    while left > 0:
        x, width = counts[i] + 1, (left + 1).bit_length()
        spare = (1 << width) - 2 - left  # values that need one bit less
        short = x < spare
        value |= (x if short or x < 1 << (width - 1) else x + spare) << at
        at += width - short
        left -= abs(counts[i])
        i += 1
        if x == 1:
            run = next(k for k in range(len(counts) - i + 1) if counts[i + k])
            i += run
            while run >= 3:
                value, at, run = value | 3 << at, at + 2, run - 3
            value, at = value | run << at, at + 2
    return value.to_bytes((at + 7) // 8, "little")


class Coder:
    """A table from the side of writing: the state before a symbol, by the state after it."""

    def __init__(self, counts, log: int):
        self.log = log
        if not log:
            self.size, self.counts, self.wide, self.places = 1, {len(counts) - 1: 1}, {len(counts) - 1: 0}, {len(counts) - 1: [0]}
            return
        size = 1 << log
        n = np.asarray(counts, np.int64)
        rare = np.flatnonzero(n == -1)  # these have the last states, downwards
        symbols = np.empty(size, np.int64)
        symbols[size - len(rare) :] = rare[::-1]
        at = np.arange(size) * ((size >> 1) + (size >> 3) + 3) & size - 1
        symbols[at[at < size - len(rare)]] = np.repeat(np.arange(len(n)), np.maximum(n, 0))
        order = np.argsort(symbols, kind="stable").tolist()
        self.size, self.counts, self.wide, self.places, begin = size, {}, {}, {}, 0
        for s, c in enumerate(np.abs(n).tolist()):
            if c:
                self.counts[s], self.wide[s], self.places[s] = c, log - c.bit_length() + 1, order[begin : begin + c]
                begin += c

    def walk(self, symbols: list[int]) -> tuple[int, list[int], list[int]]:
        """The first state, and the value and width of the step after each symbol but the last."""
        counts, wide, places, size = self.counts, self.wide, self.places, self.size
        state = places[symbols[-1]][0]
        values, widths = [], []
        for s in symbols[-2::-1]:
            bits, t = wide[s], state + size
            k = (t >> bits) - counts[s]
            if k < 0:
                bits -= 1
                k = (t >> bits) - counts[s]
            values.append(t & ((1 << bits) - 1))
            widths.append(bits)
            state = places[s][k]
        return state, values[::-1], widths[::-1]


@cache
def _default(name: str) -> Coder:
    counts, log = {"ll": (LL_NORM, 6), "of": (OF_NORM, 5), "ml": (ML_NORM, 6)}[name]
    return Coder(counts, log)


# Literals


def tree_weights(lengths: np.ndarray) -> np.ndarray:
    return np.where(lengths > 0, lengths.max() + 1 - lengths, 0)


def tree_codes(lengths: np.ndarray) -> np.ndarray:
    """The code of each symbol: cells of the reader's table go to light symbols first."""
    weights = tree_weights(lengths)
    cells = np.where(weights > 0, 1 << np.maximum(weights - 1, 0), 0)
    order = np.lexsort((np.arange(len(weights)), weights))
    start = np.zeros(len(weights), np.int64)
    start[order] = np.cumsum(cells[order]) - cells[order]
    return start >> np.maximum(weights - 1, 0)


def tree_description(lengths: np.ndarray) -> bytes | None:
    """The weights of all symbols but the last present one, which follows from them: coded if that is shorter, else as half bytes; None if there are too many for that."""
    top = int(np.flatnonzero(lengths)[-1])
    weights = tree_weights(lengths)[:top].tolist()
    plain = None
    if top <= 128:
        pairs = [*weights, 0][: top + top % 2]
        plain = bytes([127 + top]) + bytes(a << 4 | b for a, b in zip(pairs[::2], pairs[1::2], strict=True))
    coded = _coded_weights(weights)
    if coded and (plain is None or len(coded) + 1 < len(plain)):
        return bytes([len(coded)]) + coded
    return plain


def _coded_weights(weights: list[int]) -> bytes | None:
    """Two states take turns. The second last weight's state must ask for bits, which are not there: that ends the list."""
    if len(weights) < 3 or len(set(weights)) < 2:
        return None
    counts = normalized(np.bincount(weights), 6 if len(weights) > 40 else 5)
    coder = Coder(counts.tolist(), int(counts.sum()).bit_length() - 1)
    (a, av, aw), (b, bv, bw) = coder.walk(weights[::2]), coder.walk(weights[1::2])
    values, widths = [a, b], [coder.log] * 2
    for i in range(len(weights) - 2):
        k = i // 2
        values.append((bv if i & 1 else av)[k])
        widths.append((bw if i & 1 else aw)[k])
    out = write_counts(counts.tolist(), coder.log) + packed(np.array(values), np.array(widths))
    return out if len(out) < 128 else None


def _plain_header(kind: int, n: int) -> bytes:
    if n < 32:
        return bytes([kind | n << 3])
    return (kind | 1 << 2 | n << 4).to_bytes(2, "little") if n < 4096 else (kind | 3 << 2 | n << 4).to_bytes(3, "little")


def _streams(a: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[bytes, bool]:
    """The literals' streams, and whether it is a single one."""
    one = lambda x: packed(codes[x], lengths[x])
    if len(a) < 256:
        return one(a), True
    part = (len(a) + 3) // 4
    parts = [one(a[i : i + part]) for i in range(0, 3 * part, part)] + [one(a[3 * part :])]
    return b"".join(len(p).to_bytes(2, "little") for p in parts[:3]) + b"".join(parts), False


def write_literals(data: bytes, lent: np.ndarray | None) -> tuple[bytes, np.ndarray | None]:
    """The literals section, and the code that it leaves for later blocks. lent: the code lengths of an earlier block."""
    n = len(data)
    raw = _plain_header(0, n) + data
    if n and data == data[:1] * n:
        return _plain_header(1, n) + data[:1], lent
    if n < 32:
        return raw, lent
    a = np.frombuffer(data, np.uint8)
    counts = np.bincount(a, minlength=256)
    lengths = code_lengths(counts, CODE_DEPTH)
    tree = tree_description(lengths)
    new = int((counts * lengths).sum()) // 8 + len(tree) if tree else n
    old = int((counts * lent).sum()) // 8 if lent is not None and (lent[counts > 0] > 0).all() else n
    if min(new, old) >= n - 8:
        return raw, lent
    use = lent if old <= new else lengths
    body, single = _streams(a, use, tree_codes(use))
    body = body if old <= new else tree + body
    if single and max(n, len(body)) > 1023 or len(body) >= n:
        return raw, lent
    form, width, size = (0, 10, 3) if single else (1, 10, 3) if max(n, len(body)) < 1024 else (2, 14, 4) if max(n, len(body)) < 16384 else (3, 18, 5)
    head = (3 if old <= new else 2) | form << 2 | n << 4 | len(body) << (4 + width)
    section = head.to_bytes(size, "little") + body
    return (section, use) if len(section) < len(raw) else (raw, lent)


# Sequences


def length_codes(values: np.ndarray, bases: tuple[int, ...]) -> np.ndarray:
    return np.searchsorted(np.array(bases), values, side="right") - 1


def _table_for(name: str, codes: np.ndarray) -> tuple[int, bytes, Coder]:
    """The mode, description and coder of one kind of codes: the least of a single symbol, the default table and a table of its own."""
    counts = np.bincount(codes)
    present = np.flatnonzero(counts)
    if len(present) == 1 and len(codes) > 2:
        return 1, bytes([int(present[0])]), Coder([0] * int(present[0]) + [1], 0)
    norm, log = {"ll": (LL_NORM, 6), "of": (OF_NORM, 5), "ml": (ML_NORM, 6)}[name]
    default = _default(name)
    fits = present[-1] < len(norm)
    bits = lambda size, table: float((counts[present] * (size - np.log2(table[present]))).sum())
    usual = bits(log, np.abs(np.array(norm))) / 8 if fits else float("inf")
    if len(present) == 1 or len(codes) < 32:
        return 0, b"", default
    own_log = max(5, min(8 if name == "of" else 9, (len(codes) - 1).bit_length() - 2, 9), (len(present) - 1).bit_length() + 1)
    own = normalized(counts, own_log)
    head = write_counts(own.tolist(), own_log)
    if bits(own_log, own) / 8 + len(head) < usual:
        return 2, head, Coder(own.tolist(), own_log)
    return 0, b"", default


def write_sequences(sequences: list[tuple[int, int, int]]) -> bytes:
    """(literals, match length, offset value) of each sequence."""
    n = len(sequences)
    head = bytes([n]) if n < 128 else bytes([(n >> 8) + 128, n & 255]) if n < 0x7F00 else b"\xff" + (n - 0x7F00).to_bytes(2, "little")
    if not n:
        return head
    ll, ml, of = (np.array(x, np.int64) for x in zip(*sequences, strict=True))
    llc, mlc = length_codes(ll, LL_BASE), length_codes(ml, ML_BASE)
    ofc = np.frexp(of.astype(float))[1].astype(np.int64) - 1  # the highest bit; values are below 2**53
    kinds = (("ll", llc), ("of", ofc), ("ml", mlc))
    chosen = {k: _table_for(k, c) for k, c in kinds}
    modes = chosen["ll"][0] << 6 | chosen["of"][0] << 4 | chosen["ml"][0] << 2
    walked = {k: chosen[k][2].walk(c.tolist()) for k, c in kinds}
    order = ("ll", "of", "ml")
    values = np.zeros((n, 6), np.int64)  # extra bits of offset, match and literals, then steps of literals, match and offset
    widths = np.zeros((n, 6), np.int64)
    values[:, 0], widths[:, 0] = of - (1 << ofc), ofc
    values[:, 1], widths[:, 1] = ml - np.array(ML_BASE)[mlc], np.array(ML_BITS)[mlc]
    values[:, 2], widths[:, 2] = ll - np.array(LL_BASE)[llc], np.array(LL_BITS)[llc]
    for j, k in enumerate(("ll", "ml", "of")):
        values[:-1, 3 + j], widths[:-1, 3 + j] = walked[k][1], walked[k][2]
    first = [walked[k][0] for k in order], [chosen[k][2].log for k in order]
    stream = packed(np.concatenate([first[0], values.ravel()]), np.concatenate([first[1], widths.ravel()]))
    return head + bytes([modes]) + b"".join(chosen[k][1] for k in order) + stream


# Matches


def candidates(data: bytes, widths: tuple[int, ...]) -> list[np.ndarray]:
    """For each width and position, the nearest earlier position with the same next bytes; -1 without one."""
    a = np.frombuffer(data + bytes(16), np.uint8)
    n = len(data)
    out = []
    for w in widths:
        m = n - w + 1
        found = np.full(n, -1, np.int64)
        if m > 1:
            keys = [a[i : i + m].astype(np.uint64) for i in range(w)]
            words = [sum((keys[8 * j + i] << np.uint64(8 * i) for i in range(min(8, w - 8 * j))), np.zeros(m, np.uint64)) for j in range((w + 7) // 8)]
            order = np.lexsort((np.arange(m), *words))
            same = np.ones(m - 1, bool)
            for x in words:
                y = x[order]
                same &= y[1:] == y[:-1]
            found[order[1:][same]] = order[:-1][same]
        out.append(found)
    return out


def common_length(data: bytes, a: int, b: int, end: int) -> int:
    """Equal bytes from a and from the later b, up to end."""
    n, step = 0, 16
    while b + n < end:
        m = min(step, end - b - n)
        x, y = data[a + n : a + n + m], data[b + n : b + n + m]
        if x != y:
            d = int.from_bytes(x, "little") ^ int.from_bytes(y, "little")
            return n + ((d & -d).bit_length() - 1) // 8
        n += m
        step = min(4 * step, 1024)
    return n


#: Bytes at which matches are compared while all positions are searched at once; the chosen ones are extended.
COMPARED = 64


class Finder:
    """Matches of a buffer whose first `begin` bytes are history: for each later position the one that saves the most, all positions searched at once; for parsing by least cost the longest and the nearest too.

    Lists begin at `begin`. `next` is the next position that has a match. Lengths of COMPARED may go on.
    """

    def __init__(self, data: bytes, begin: int, window: int, strategy: str):
        self.data, self.begin, self.window, self.end = data, begin, window, len(data)
        depth, self.ahead = EFFORT[strategy]
        widths = (4,) if strategy in ("fast", "greedy", "lazy") else (8, 4) if strategy in ("dfast", "lazy2") else (16, 8, 4)
        n = self.end - begin
        self._bytes = np.frombuffer(data + bytes(COMPARED + 16), np.uint8)
        self._words = np.empty(len(data) + COMPARED + 8, np.uint64)
        for k in range(8):
            part = np.frombuffer(self._bytes, "<u8", count=(len(self._bytes) - k) // 8, offset=k)
            self._words[k::8] = part[: len(self._words[k::8])]
        score, size, distance = np.full(n, -1), np.zeros(n, np.int64), np.zeros(n, np.int64)
        longest, far, short, near = np.full(n, MIN_MATCH - 1), np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
        tried = np.zeros(n, np.int64)
        for chain in candidates(data, widths):
            at = np.flatnonzero((chain[begin:] >= 0) & (longest < COMPARED)) + begin
            c = chain[at]
            for _ in range(depth):
                live = (c >= 0) & (at - c <= window) & (tried[at - begin] < depth)
                at, c = at[live], c[live]
                if not len(at):
                    break
                tried[at - begin] += 1
                best = longest[at - begin]
                longer = self._bytes[c + best] == self._bytes[at + best]
                i, j = at[longer], c[longer]
                m = self._common(j, i)
                up = m > best[longer]
                i, j, m = i[up], j[up], m[up]
                r, d = i - begin, i - j
                longest[r], far[r] = m, d
                if self.ahead is None:
                    up = (near[r] == 0) | (d < near[r])
                    short[r[up]], near[r[up]] = m[up], d[up]
                gain = 4 * m - np.frexp((d + 3).astype(float))[1]
                up = gain > score[r]
                r = r[up]
                score[r], size[r], distance[r] = gain[up], m[up], d[up]
                c = chain[c]
        some = np.flatnonzero(size)
        self.short, self.near = (short.tolist(), near.tolist()) if self.ahead is None else ([], [])
        self.size, self.distance, self.longest, self.far = size.tolist(), distance.tolist(), longest.tolist(), far.tolist()
        self.next = np.append(some, n)[np.searchsorted(some, np.arange(n + 1))].tolist()

    def _common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Equal bytes from each of a and of the later b, COMPARED at most."""
        out, room = np.full(len(a), COMPARED), self.end - b
        at = np.arange(len(a))
        for k in range(0, COMPARED, 8):
            x = self._words[a + k] ^ self._words[b + k]
            ends = np.flatnonzero(x)
            y = x[ends]
            out[at[ends]] = k + (np.bitwise_count((y & -y) - np.uint64(1)) >> 3)
            on = np.flatnonzero(x == 0)
            if not len(on):
                break
            a, b, at = a[on], b[on], at[on]
        return np.minimum(out, room)

    def whole(self, i: int, length: int, distance: int, end: int) -> int:
        """The length of a match at a position, up to end."""
        if length >= COMPARED:
            return common_length(self.data, i - distance, i, min(end, i + MAX_MATCH))
        return min(length, end - i)


def offset_value(distance: int, literals: int, repeats: list[int | None]) -> int:
    """How a distance is written: 1 to 3 for a repeat, else 3 more than it; the repeats move on. An unknown repeat (None) is never used."""
    known = repeats if literals else [repeats[1], repeats[2], repeats[0] - 1 if repeats[0] is not None else None]
    if distance in known:
        k = known.index(distance)
        if literals:
            repeats.insert(0, repeats.pop(k))
        elif k < 2:
            repeats.insert(0, repeats.pop(k + 1))
        else:
            repeats[:] = [distance, repeats[0], repeats[1]]
        return k + 1
    repeats[:] = [distance, repeats[0], repeats[1]]
    return distance + 3


def _best(f: Finder, i: int, end: int, repeats: list[int | None]) -> tuple[int, int, int]:
    """(gain, length, distance) of the match at a position that saves the most, repeats among them; without one the gain is negative."""
    n, d = f.size[i - f.begin], f.distance[i - f.begin]
    if n:
        n = f.whole(i, n, d, end)
    gain = 4 * n - (d + 3).bit_length() if n >= MIN_MATCH else -1
    data, key = f.data, f.data[i : i + MIN_MATCH]
    for e in repeats:
        if e and e <= i and e <= f.window and data[i - e : i - e + MIN_MATCH] == key and i + MIN_MATCH <= end:
            m = common_length(data, i - e, i, min(end, i + MAX_MATCH))
            if 4 * m - 1 > gain:
                gain, n, d = 4 * m - 1, m, e
    return gain, n, d


def _parse_ahead(f: Finder, begin: int, end: int, repeats: list[int | None]) -> list[tuple[int, int, int]]:
    """(literals, length, offset value): the best match at a position, unless one that begins up to `ahead` bytes later saves more. repeats move on."""
    out, i, from_, data, first, following = [], begin, begin, f.data, f.begin, f.next
    while True:
        i = first + following[i - first]
        if i + MIN_MATCH > end:
            return out
        gain, n, d = _best(f, i, end, repeats)
        if gain < 0:
            i += 1
            continue
        for step in range(1, f.ahead + 1):
            j = i + step
            if j + MIN_MATCH > end:
                break
            if not f.size[j - first]:
                continue
            g, m, e = _best(f, j, end, repeats)
            if g > gain + 4 * step:
                i, n, d = j, m, e
                break
        while i > from_ and i > d and data[i - 1] == data[i - 1 - d]:  # the match may begin earlier
            i, n = i - 1, n + 1
        out.append((i - from_, n, offset_value(d, i - from_, repeats)))
        i += n
        from_ = i


def _parse_least_cost(f: Finder, begin: int, end: int, repeats: list[int | None]) -> list[tuple[int, int, int]]:
    """(literals, length, offset value) by the least estimated bits from each position to the block's end. Literals cost their share of the block, matches their codes. repeats move on."""
    a = np.frombuffer(f.data, np.uint8)[begin:end]
    counts = np.bincount(a, minlength=256)
    price = np.minimum(8.0, np.log2(max(1, len(a)) / np.maximum(counts, 1)) + 0.3)[a].tolist() if len(a) else []
    first = {d for d in repeats if d is not None}
    size, low = end - begin, begin - f.begin
    cost, step = [0.0] * (size + 1), [(0, 0)] * (size + 1)
    for i in range(size - 1, -1, -1):
        best, take = price[i] + cost[i + 1], (0, 0)
        k = low + i
        if f.size[k]:
            for n, d in {(f.short[k], f.near[k]), (f.size[k], f.distance[k]), (f.longest[k], f.far[k])}:
                n = f.whole(begin + i, n, d, end)  # noqa: PLW2901
                bits = (4 if d in first else 7 + (d + 3).bit_length()) + n.bit_length() // 2
                for m in (n, n - 1, n >> 1):
                    if m >= MIN_MATCH and bits + cost[i + m] < best:
                        best, take = bits + cost[i + m], (m, d)
        cost[i], step[i] = best, take
    out, i, from_ = [], 0, 0
    while i < size:
        n, d = step[i]
        if n:
            out.append((i - from_, n, offset_value(d, i - from_, repeats)))
            from_ = i + n
        i += n or 1
    return out


# Blocks and frames


@dataclass
class BlockState:
    """What blocks of one frame pass on, as plain values."""

    repeats: list[int | None] = field(default_factory=lambda: [1, 4, 8])
    lent: np.ndarray | None = None


def block_bytes(kind: int, last: bool, size: int, body: bytes) -> bytes:
    return (int(last) | kind << 1 | size << 3).to_bytes(3, "little") + body


def encode_block(f: Finder, begin: int, end: int, last: bool, state: BlockState) -> bytes:
    """One block of at most 128 KiB of a finder's buffer."""
    part = f.data[begin:end]
    if len(part) > 1 and part == part[:1] * len(part):
        return block_bytes(1, last, len(part), part[:1])
    parse = _parse_least_cost if f.ahead is None else _parse_ahead
    repeats, literals, at = list(state.repeats), [], begin
    sequences = parse(f, begin, end, repeats) if len(part) > MIN_MATCH else []
    for count, length, _ in sequences:
        literals.append(f.data[at : at + count])
        at += count + length
    literals.append(f.data[at:end])
    section, lent = write_literals(b"".join(literals), state.lent)
    body = section + write_sequences(sequences)
    if len(body) >= len(part):
        return block_bytes(0, last, len(part), part)
    state.repeats, state.lent = repeats, lent
    return block_bytes(2, last, len(body), body)


def encode_blocks(data: bytes, history: bytes, last: bool, state: BlockState, window: int, strategy: str) -> bytes:
    """All of data as blocks, after history that the frame has already (or a dictionary). Without data there is a block only if it is to be the last."""
    if not data:
        return block_bytes(0, True, 0, b"") if last else b""
    f, size = Finder(history + data, len(history), window, strategy), min(BLOCK_MAX, window)  # no block is larger than the window
    return b"".join(encode_block(f, i, min(i + size, f.end), last and i + size >= f.end, state) for i in range(len(history), f.end, size))


def frame_head(content: int | None, window_log: int, checksum: bool, dict_id: int = 0) -> bytes:
    """The header: a single segment if the content is known and fits in the window and in 256 KiB."""
    single = content is not None and content <= 1 << window_log and content < 256 << 10
    id_size = 0 if not dict_id else 1 if dict_id < 1 << 8 else 2 if dict_id < 1 << 16 else 4
    if content is None or content < 256 and not single:
        size, code = 0, 0
        if content is not None:
            size, code = 4, 2
    else:
        size, code = (1, 0) if content < 256 else (2, 1) if content < 65536 + 256 else (4, 2) if content < 1 << 32 else (8, 3)
    flags = code << 6 | single << 5 | checksum << 2 | {0: 0, 1: 1, 2: 2, 4: 3}[id_size]
    field_ = b"" if not size else (content - 256 if size == 2 else content).to_bytes(size, "little")
    return MAGIC.to_bytes(4, "little") + bytes([flags]) + (b"" if single else bytes([window_log - 10 << 3])) + dict_id.to_bytes(id_size, "little") + field_


def window_log_for(n: int, wanted: int = 0) -> int:
    return wanted or max(10, min(23, max(n - 1, 1).bit_length()))


def encode_frame(
    data: bytes, strategy: str = "lazy", checksum: bool = False, window_log: int = 0, content_size: bool = True, dictionary: bytes = b"", dict_id: int = 0, state: BlockState | None = None
) -> bytes:
    """One whole frame. dictionary: raw content that comes before the data; state: what a prepared dictionary lends the first block."""
    log = window_log_for(len(data), window_log)
    window = max(1 << log, len(data)) if len(data) < 256 << 10 and content_size and len(data) <= 1 << log else 1 << log
    blocks = encode_blocks(data, dictionary[-window:] if dictionary else b"", True, state or BlockState(), window, strategy)
    end = (xxhash.xxh64_intdigest(data) & 0xFFFFFFFF).to_bytes(4, "little") if checksum else b""
    return frame_head(len(data) if content_size else None, log, checksum, dict_id) + blocks + end


class StreamEncoder:
    """A frame that goes on: bytes come in, whole blocks leave. Only plain values are held: the window, what no block has taken, and the state of blocks and checksum.

    pledged: the content's size, declared in the header; another size at the end raises ValueError.
    """

    def __init__(self, strategy: str = "lazy", window_log: int = 17, checksum: bool = False, pledged: int | None = None, dictionary: bytes = b"", dict_id: int = 0):
        if strategy not in STRATEGIES:
            raise ValueError(f"no strategy {strategy}")
        self.options = strategy, window_log, checksum, pledged, dictionary, dict_id
        self.reset()

    def reset(self) -> None:
        """A new frame with the same options; what has not left is dropped."""
        self.history, self.rest, self.state, self.hash = self.options[4], b"", BlockState(), XXH64()
        self.open, self.taken = False, 0

    def write(self, data: bytes, flush: bool = False, end: bool = False) -> bytes:
        """The bytes that can leave: full blocks of 128 KiB, with flush or end all that came in. After an end the next frame begins."""
        strategy, window_log, checksum, pledged, _, dict_id = self.options
        data = self.rest + data
        take = len(data) if flush or end else len(data) // BLOCK_MAX * BLOCK_MAX
        now, self.rest = data[:take], data[take:]
        if not (now or flush or end):
            return b""
        out = b""
        if not self.open:
            known = len(now) if end and pledged is None else pledged
            out = frame_head(known, window_log, checksum, dict_id)
            self.open = True
        self.taken += len(now)
        if pledged is not None and (self.taken > pledged or end and self.taken != pledged):
            raise ValueError("SrcSizeWrong")
        window = 1 << window_log
        out += encode_blocks(now, self.history[-window:], end, self.state, window, strategy)
        self.history = (self.history + now)[-window:]
        if checksum:
            self.hash.update(now)
        if end:
            out += (self.hash.digest() & 0xFFFFFFFF).to_bytes(4, "little") if checksum else b""
            self.reset()
        return out
