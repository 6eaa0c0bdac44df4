"""Line dedup: range-partitioned line hashes, streamed in order of document and position.

1. Every text sends one row for each distinct line key of enough characters: the key's 128-bit hash, the document and the line's first position.
2. The rows are range-partitioned by (hash, document descending, position) and sorted, so a key that a third of all documents hold spreads over many partitions.
   Rows and partitions are checkpointed, as both are read twice.
3. Each partition reports its first and last key with the number of documents it saw (at most `min_docs`): a row per partition. Windows over these rows say what every partition
   needs to know of its neighbours, and that row is joined to it.
4. Each partition streams its rows. The first document of a key, the largest id, keeps its lines; once `min_docs` documents have been seen, all others lose them.
   Only one batch and what waits for the last document needed are held.
5. The dropped keys return to their documents, which yield a zlib-compressed bitmap of the lines that stay.

Defined cases: a null or empty text is one empty line; rows with a null id are documents of their own, told apart by their texts and smaller than all others; rows that share an id
are one document as to who holds a key, each with its own bitmap; lines and texts of any length are read whole; equal lines of the keeper all stay; further columns stay; columns with the result's names are replaced; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framequarry.llm._common import LOWER, UPPER, WHITESPACE, checkpointed, row_ids
from framequarry.llm._words import slices

_TO_LOWER = str.maketrans(UPPER, LOWER)


def line_key(line: str) -> str:
    return line.strip(WHITESPACE).translate(_TO_LOWER)


def _key_hash(line: str, min_chars: int) -> bytes | None:
    key = line_key(line)
    return xxhash.xxh3_128_digest(key.encode()) if len(key) >= min_chars else None


def _as_longs(digests: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(digests), ">i8").reshape(-1, 2)
    return both[:, 0].astype(np.int64), both[:, 1].astype(np.int64)


def _keys(min_chars: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            digests, docs, at = [], [], []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                first: dict[bytes, int] = {}
                for i, line in enumerate((text or "").split("\n")):
                    if len(line) >= min_chars and (h := _key_hash(line, min_chars)) is not None:
                        first.setdefault(h, i)
                digests += first
                docs += [doc] * len(first)
                at += first.values()
            h1, h2 = _as_longs(digests)
            yield pa.RecordBatch.from_arrays([pa.array(h1), pa.array(h2), pa.array(docs, pa.int64()), pa.array(at, pa.int64())], names=["h1", "h2", "id_", "line"])

    return run


def _columns(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return tuple(b.column(c).to_numpy(zero_copy_only=False) for c in ("h1", "h2", "id_"))


def _documents(b: pa.RecordBatch, last: tuple | None) -> tuple[np.ndarray, ...]:
    """Rows of a sorted batch that begin a document of a key (last: the row before it), and which of those begin a key."""
    h1, h2, docs = _columns(b)
    new_key = np.ones(len(h1), bool)
    new_key[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
    new_doc = new_key.copy()
    new_doc[1:] |= docs[1:] != docs[:-1]
    if last is not None and len(h1):
        new_key[0] = (h1[0], h2[0]) != last[:2]
        new_doc[0] = new_key[0] or docs[0] != last[2]
    keep = np.flatnonzero(new_doc)
    return h1[keep], h2[keep], docs[keep], new_key[keep]


def _ends(min_docs: int) -> Callable:
    """A partition's first key and, if it is another one, its last key: the documents seen of it, and the ids at the partition's ends (null where the key does not reach that end)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, first_n, last, last_n, one, head, pid = None, 0, None, 0, True, None, None
        for b in batches:
            if not b.num_rows:
                continue
            pid = b.column("pid")[0].as_py()
            h1, h2, docs, new_key = _documents(b, last)
            begins = np.flatnonzero(new_key)
            if len(h1):
                if first is None:
                    first, head = (h1[0], h2[0]), docs[0]
                    begins = begins[1:]
                lead = begins[0] if len(begins) else len(h1)
                if one:
                    first_n += int(lead)
                last_n = len(h1) - int(begins[-1]) if len(begins) else last_n + len(h1)
                one = one and not len(begins)
            last = tuple(x[-1] for x in _columns(b))
        if first is not None:
            rows = [(pid, 0, *map(int, first), min(first_n, min_docs), int(head), int(last[2]) if one else None)]
            if not one:
                rows.append((pid, 1, *map(int, last[:2]), min(last_n, min_docs), None, int(last[2])))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], names=_END_NAMES)

    return run


_END_NAMES = ["pid", "kind", "k1", "k2", "n", "head", "tail"]


def _carried(ends: DataFrame) -> DataFrame:
    """For each partition (pid): documents of its first key in the partitions before (n_before), the id just before it (doc_before), and documents of its last key in those after it (n_after).

    Windows over the ends of one key, of which there are two for each partition at most. A document whose rows of one key lie on both sides of a border counts once.
    """
    of_key = Window.partitionBy("k1", "k2").orderBy("pid")
    twice = F.coalesce((F.lag("tail").over(of_key) == F.col("head")).cast("long"), F.lit(0))
    rows = ends.withColumns({"own": F.col("n") - twice, "doc": F.lag("tail").over(of_key)})
    total = lambda a, b: F.coalesce(F.sum("own").over(of_key.rowsBetween(a, b)), F.lit(0))
    rows = rows.withColumns({"before": total(Window.unboundedPreceding, -1), "after": total(1, Window.unboundedFollowing)})
    begins = F.col("kind") == 0
    return rows.groupBy("pid").agg(F.max(F.when(begins, F.col("before"))).alias("n_before"), F.max(F.when(begins, F.col("doc"))).alias("doc_before"), F.max_by("after", "kind").alias("n_after"))


def _dropped(min_docs: int) -> Callable:
    """Sorted rows, with what their partition has to know of its neighbours, to (document, key hash) that lose their lines."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_before, doc_before, n_after = 0, None, 0
        last, seen, waits = None, 0, []  # of the key that runs on: documents so far, and those that lose it if enough come
        begun = False

        def enough(total: int) -> bool:
            return total >= min_docs

        for b in batches:
            if not b.num_rows:
                continue
            if not begun:
                n_before, doc_before, n_after = (b.column(c)[0].as_py() for c in ("n_before", "doc_before", "n_after"))
            if not begun and n_before:
                last = (*(x[0] for x in _columns(b)[:2]), doc_before)
                seen = n_before
            begun = True
            h1, h2, docs, new_key = _documents(b, last)
            out: list[tuple[np.ndarray, ...]] = []
            begins = np.flatnonzero(new_key)
            lead = int(begins[0]) if len(begins) else len(h1)
            if lead:  # more documents of the running key
                keep_first = seen == 0
                run_on = [(h1[i], h2[i], docs[i]) for i in range(int(keep_first), lead)] if seen + lead < min_docs else None
                if run_on is None:
                    out.append((h1[int(keep_first) : lead], h2[int(keep_first) : lead], docs[int(keep_first) : lead]))
                    if waits:
                        out.append(tuple(np.array(x, np.int64) for x in zip(*waits, strict=True)))
                        waits = []
                else:
                    waits += run_on
                seen += lead
            if len(begins):
                waits = []
                sizes = np.diff(np.append(begins, len(h1)))
                whole = np.repeat(sizes >= min_docs, sizes)
                whole &= ~new_key[lead:]
                at = np.flatnonzero(whole) + lead
                out.append((h1[at], h2[at], docs[at]))
                seen = int(sizes[-1])
                if not enough(seen):
                    waits = [(h1[i], h2[i], docs[i]) for i in range(int(begins[-1]) + 1, len(h1))]
            last = tuple(x[-1] for x in _columns(b))
            if out and sum(len(o[0]) for o in out):
                a, c, d = (np.concatenate(x) for x in zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(d, pa.int64()), pa.array(a, pa.int64()), pa.array(c, pa.int64())], names=["id_", "h1", "h2"])
        if waits and enough(seen + n_after):
            a, c, d = (np.array(x, np.int64) for x in zip(*waits, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(d), pa.array(a), pa.array(c)], names=["id_", "h1", "h2"])

    return run


def pack_bitmap(kept: np.ndarray) -> bytes:
    return zlib.compress(np.packbits(kept, bitorder="little").tobytes(), 6)


def unpack_bitmap(bitmap: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), count=n, bitorder="little").astype(bool)


def _bitmaps(min_chars: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            n_lines, n_dropped, maps = [], [], []
            for text, gone in zip(b.column("text_").to_pylist(), b.column("gone_").to_pylist(), strict=True):
                lines = (text or "").split("\n")
                kept = np.ones(len(lines), bool)
                if gone:
                    lost = set(gone)
                    kept[:] = [_key_hash(x, min_chars) not in lost for x in lines]
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - int(kept.sum()))
                maps.append(pack_bitmap(kept))
            names = [c for c in b.schema.names if c != "gone_"]
            cols = [b.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(maps, pa.binary())], names=[*names, "n_lines", "n_dropped", "keep_bitmap"])

    return run


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        kept = []
        for text, bitmap in zip(b.column("text_").to_pylist(), b.column("keep_bitmap").to_pylist(), strict=True):
            lines = (text or "").split("\n")
            kept.append("\n".join(x for x, k in zip(lines, unpack_bitmap(bitmap, len(lines)), strict=True) if k))
        names = [c for c in b.schema.names if c not in ("text_", "keep_bitmap")]
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(kept, pa.string())], names=[*names, "kept_text"])


def _marked(df: DataFrame, id_col: str, text_col: str, min_chars: int, min_docs: int) -> DataFrame:
    """df with its text as text_, and n_lines, n_dropped and keep_bitmap."""
    id_ = row_ids(id_col, text_col)
    rows = df.select(id_.alias("id_"), F.col(text_col).alias("text_")).mapInArrow(_keys(min_chars), "h1 long, h2 long, id_ long, line long")
    rows = checkpointed(rows)  # range partitioning reads them twice, first for a sample
    order = ("h1", "h2", F.desc("id_"), "line")
    ranged = checkpointed(rows.repartitionByRange(*order).sortWithinPartitions(*order))
    # a checkpoint keeps its partitions, and there is one row of four numbers for each of them, which bounds what is broadcast
    placed = ranged.withColumn("pid", F.spark_partition_id().cast("long"))
    carried = _carried(placed.mapInArrow(_ends(min_docs), ", ".join(f"{c} long" for c in _END_NAMES)))
    placed = placed.join(F.broadcast(carried), "pid")
    lost = placed.mapInArrow(_dropped(min_docs), "id_ long, h1 long, h2 long")
    digest = F.unhex(F.concat(F.lpad(F.hex("h1"), 16, "0"), F.lpad(F.hex("h2"), 16, "0")))
    gone = lost.groupBy("id_").agg(F.collect_set(digest).alias("gone_"))
    names = {"text_", "gone_", "id_", "n_lines", "n_dropped", "keep_bitmap", "kept_text"}
    rest = [c for c in df.columns if c not in names | {text_col}]
    texts = df.select(*rest, F.col(text_col).alias("text_"), id_.alias("id_"))
    joined = texts.join(gone, "id_", "left").select(*rest, "text_", "gone_")
    schema = joined.drop("gone_").schema.add("n_lines", "long").add("n_dropped", "long").add("keep_bitmap", "binary")
    return joined.mapInArrow(_bitmaps(min_chars), schema)


def line_bitmaps(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """df without its text, with n_lines, n_dropped and keep_bitmap: bit i (little-endian, zlib-compressed) is 1 if line i stays."""
    return _marked(df, id_col, text_col, min_chars, min_docs).drop("text_")


def apply_bitmaps(marked: DataFrame) -> DataFrame:
    """Rows with text_ and keep_bitmap to rows with kept_text, the lines that stay, joined by \\n."""
    schema = marked.drop("text_", "keep_bitmap").schema.add("kept_text", "string")
    return marked.mapInArrow(_apply, schema)


def deduplicated(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """df without its text, with n_lines, n_dropped and kept_text."""
    return apply_bitmaps(_marked(df, id_col, text_col, min_chars, min_docs))
