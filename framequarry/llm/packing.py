"""Packing by vector bins: examples under simultaneous limits on tokens, segments and loss-bearing tokens.

Each task packs the examples of its own input split, so nothing is shuffled and a hot source spreads as its files do. A task holds a pool of pieces. The bin that is
open takes, among the pieces that fit in all three limits, the one with the largest dot product of its size and what is left (both as shares of the limits): pieces go
where their shape matches the room. When none fits, the room is filled by cutting the largest piece; a bin whose other limits are reached, and the last one of
a task, end at powers of two, which need no padding.

Token ids are those of the vocabulary file given. The pair ranks of plain byte-level BPE files are run by the tiktoken library, which gives the ids of the tokenizers
library (the tests compare both) in a fifth of the time; other files are run by the tokenizers library itself.

Defined cases: a null text is empty and has the end id alone; a null id stays null; repeated rows are packed each on its own; long texts are cut into whole
sequences first, and runs of white space, letters or digits may have any length; of pieces with equal dot products the one that came first is taken; further columns
are not carried; an empty table gives an empty result.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framequarry.llm._words import slices

#: Pieces that a task holds before it fills bins.
POOL = 384
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, loss_tokens long"
#: The split pattern of byte-level BPE vocabularies of this kind.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: What `\s` means in that pattern.
SPACES = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: In texts from this length on, runs of white space from that length on are cut out before the pattern runs: its look-ahead needs stack for each character of a run.
LONG_TEXT, LONG_RUN = 100_000, 1000
_ENCODERS: dict[str, Callable[[str], np.ndarray]] = {}


def _byte_of_character() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves and the others as characters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _runs_by_ranks(spec: dict) -> bool:
    """Whether a tokenizer file is plain byte-level BPE whose merges are in the order of their ids: then ranks and the pattern above give its ids."""
    model, before = spec["model"], spec.get("pre_tokenizer") or {}
    plain = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    bytewise = before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
    special = all(t["special"] and not (t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]) for t in spec["added_tokens"])
    if not (plain and bytewise and special) or spec.get("normalizer"):
        return False
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    ids = [model["vocab"].get("".join(p), -1) for p in pairs]
    return all(a < b for a, b in zip([255, *ids], ids, strict=False)) and all(model["vocab"].get(c, 256) < 256 for c in _byte_of_character())


def _ranked(spec: dict) -> Callable[[str], np.ndarray]:
    import tiktoken

    back = _byte_of_character()
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = {bytes(back[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    code = tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
    run = re.compile(f"[{SPACES}]{{{LONG_RUN},}}")
    apart = re.compile("(" + "|".join(map(re.escape, special)) + ")") if special else None

    def ids(text: str) -> np.ndarray:
        if len(text) < LONG_TEXT or not run.search(text):
            return code.encode_to_numpy(text, allowed_special="all")
        out: list[int] = []
        for k, part in enumerate(apart.split(text) if apart else [text]):
            if k % 2:
                out.append(special[part])
                continue
            at = 0
            for m in run.finditer(part):
                # the pattern takes a run whole at the end of its part, else but for the last character, which may belong to a word
                stop = m.end() if m.end() == len(part) else m.end() - 1
                out += code.encode_ordinary(part[at : m.start()])
                out += code._encode_single_piece(part[m.start() : stop].encode())
                at = stop
            out += code.encode_ordinary(part[at:])
        return np.array(out, np.uint32)

    return ids


def _by_library(path: str) -> Callable[[str], np.ndarray]:
    from tokenizers import Tokenizer

    code = Tokenizer.from_file(path)
    return lambda text: np.array(code.encode(text, add_special_tokens=False).ids, np.uint32)


def encoder(path: str) -> Callable[[str], np.ndarray]:
    """Text to ids by the vocabulary file, one function per worker. Files that are not plain byte-level BPE are run by the tokenizers library."""
    if path not in _ENCODERS:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        _ENCODERS[path] = _ranked(spec) if _runs_by_ranks(spec) else _by_library(path)
    return _ENCODERS[path]


class Piece:
    """Consecutive ids of one example; `free` of them from the front bear no loss."""

    __slots__ = ("doc", "start", "ids", "total", "free")

    def __init__(self, doc, start, ids, total, free):
        self.doc, self.start, self.ids, self.total, self.free = doc, start, ids, total, free

    def size(self) -> tuple[int, int, int]:
        return len(self.ids), 1, max(0, len(self.ids) - self.free)

    def cut(self, n: int) -> tuple[Piece, Piece]:
        return (
            Piece(self.doc, self.start, self.ids[:n], self.total, min(n, self.free)),
            Piece(self.doc, self.start + n, self.ids[n:], self.total, max(0, self.free - n)),
        )


class Packer:
    """Turns examples into sequences; yields lists of pieces in their order."""

    def __init__(self, length: int, segments: int, loss: int):
        self.limits = np.array([length, segments, loss], float)
        self.pool: list[Piece] = []

    def add(self, piece: Piece) -> Iterator[list[Piece]]:
        length, loss = int(self.limits[0]), int(self.limits[2])
        while len(piece.ids) >= length and (loss >= length or piece.cut(length)[0].size()[2] <= loss):
            head, piece = piece.cut(length)
            yield [head]
        if len(piece.ids):
            self.pool.append(piece)
        while len(self.pool) >= POOL:
            yield from self._ended(self._filled())

    def finish(self) -> Iterator[list[Piece]]:
        while self.pool:
            yield from self._ended(self._filled())

    def _filled(self) -> list[Piece]:
        sizes = np.array([p.size() for p in self.pool], float)
        live = np.ones(len(sizes), bool)
        room, out = self.limits.copy(), []
        while True:
            fits = np.flatnonzero(live & (sizes <= room).all(axis=1))
            if not len(fits):
                break
            k = fits[np.argmax(sizes[fits] / self.limits @ (room / self.limits))]
            out.append(self.pool[k])
            room -= sizes[k]
            live[k] = False
        self.pool = [p for p, x in zip(self.pool, live, strict=True) if x]
        if self.pool and room[0] > 0 and room[1] > 0 and room[2] > 0:
            k = max(range(len(self.pool)), key=lambda i: len(self.pool[i].ids))
            n = int(min(room[0], room[2] + self.pool[k].free, len(self.pool[k].ids) - 1))
            if n > 0:
                head, self.pool[k] = self.pool[k].cut(n)
                out.append(head)
        return out

    def _ended(self, pieces: list[Piece]) -> Iterator[list[Piece]]:
        """A full bin as it is; another as sequences of powers of two."""
        left = sum(len(p.ids) for p in pieces)
        while left:
            want = left if left == int(self.limits[0]) else 1 << (left.bit_length() - 1)
            out, have = [], 0
            while have < want:
                p = pieces.pop(0)
                if have + len(p.ids) > want:
                    p, rest = p.cut(want - have)
                    pieces.insert(0, rest)
                out.append(p)
                have += len(p.ids)
            left -= want
            yield out
            if left and self.pool:  # what is left joins the next bin
                self.pool = pieces + self.pool
                return


def _pack(path: str, length: int, segments: int, loss: int, end_id: int) -> Callable:
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        packer, sequence = Packer(length, segments, loss), TaskContext.get().partitionId() << 33
        rows: list[tuple] = []

        def take(sequences: Iterator[list[Piece]]) -> None:
            nonlocal sequence
            for pieces in sequences:
                offset = 0
                for p in pieces:
                    rows.append((p.doc, p.start, len(p.ids), zlib.crc32(p.ids.tobytes()), p.total, sequence, offset, p.size()[2]))
                    offset += len(p.ids)
                sequence += 1

        def sent() -> pa.RecordBatch:
            cols = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
            rows.clear()
            return pa.RecordBatch.from_arrays(cols, names=names)

        for b in slices(batches):
            code = encoder(path)
            for doc, text, prompt in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                ids = np.append(code(text or ""), end_id).astype("<u4")
                free = len(code(prompt)) if prompt else 0
                take(packer.add(Piece(doc, 0, ids, len(ids), free)))
            if rows:
                yield sent()
        take(packer.finish())
        if rows:
            yield sent()

    return run


def pack(
    df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", prompt_col: str | None = None, length: int = 2048, segments: int = 256, loss: int | None = None, end_id: int = 1
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, loss_tokens.

    prompt_col: the leading part of the text that bears no loss, as in instruction data (its tokens are counted on its own). A sequence has at most `length` tokens,
    `segments` pieces and `loss` (default: `length`) loss-bearing tokens, and is `length` or a power of two tokens long, so it needs no padding.
    """
    if length & (length - 1):
        raise ValueError("the sequence length must be a power of two")
    prompt = F.col(prompt_col) if prompt_col else F.lit(None)
    rows = df.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"), prompt.cast("string").alias("prompt_"))
    return rows.mapInArrow(_pack(vocabulary, length, segments, loss or length, end_id), SCHEMA)
