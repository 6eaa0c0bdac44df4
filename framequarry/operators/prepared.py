"""Standard dictionaries: their tables, repeat offsets and content, parsed once and lent to the first block of each frame."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from framequarry.functions.frames import MAGIC_DICTIONARY
from framequarry.operators.decoder import State, read_counts, read_tree, state_table
from framequarry.operators.encoder import BlockState
from framequarry.operators.walk import FrameError

# The tables' order, largest symbol and largest log.
TABLES = (("of", 31, 8), ("ml", 52, 9), ("ll", 35, 9))


@dataclass(frozen=True)
class Prepared:
    """dict_id 0 and no tables: raw content."""

    dict_id: int
    content: bytes
    tree: tuple | None = None
    tables: dict = field(default_factory=dict)
    repeats: tuple[int, int, int] = (1, 4, 8)

    @property
    def entropy_tables(self) -> dict:
        """The logs of the tables, and the depth of the literals' code; empty for raw content."""
        return {k: log for k, (_, log) in self.tables.items()} | ({"literals": self.tree[1]} if self.tree else {})

    def for_decoding(self) -> State:
        return State(tree=self.tree, tables=dict(self.tables), repeats=list(self.repeats))

    def for_encoding(self) -> BlockState:
        lengths = None
        if self.tree:
            lengths = np.zeros(256, np.int64)
            for symbol, bits in self.tree[0]:
                lengths[symbol] = bits
        return BlockState(list(self.repeats), lengths)


def from_content(content: bytes) -> Prepared:
    return Prepared(0, content)


def prepare(b: bytes) -> Prepared:
    """A dictionary with tables: magic, id, a prefix code, three tables, three repeats that lie within the content, and the content."""
    if len(b) < 8 or int.from_bytes(b[:4], "little") != MAGIC_DICTIONARY:
        raise FrameError("InvalidDictionary")
    try:
        tree = read_tree(b[8:])
        at, tables = 8 + tree[2], {}
        for name, top, most in TABLES:
            counts, log, used = read_counts(b[at:], top, most)
            tables[name] = state_table(counts, log), log
            at += used
    except FrameError as e:
        raise FrameError("DictionaryCorrupted") from e
    repeats = tuple(int.from_bytes(b[at + i : at + i + 4], "little") for i in (0, 4, 8))
    content = b[at + 12 :]
    if len(b) < at + 12 or not all(0 < r <= len(content) for r in repeats):
        raise FrameError("DictionaryCorrupted")
    return Prepared(int.from_bytes(b[4:8], "little"), content, tree, tables, repeats)
