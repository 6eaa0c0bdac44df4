"""Substring dedup by difference-cover anchors.

The cover {0, 1, 3, 9} modulo 13 holds every difference: for any two starts i and j some shift below 13 takes both to cover positions. Two equal windows of 20
words therefore share an anchor, the hash of 20 - 13 + 1 = 8 words at cover positions of both texts. So only 4 of 13 positions are hashed and exchanged, and only
windows around an anchor that occurs twice are looked at further.

1. Anchors: each task finds those that occur twice in its own chunk of texts, and sends one copy of each distinct anchor to the bucket of its hash. A bucket finds
   those that two chunks sent.
2. Extension: the windows around the repeated anchors are hashed whole (128 bits). Of equal windows in one chunk only the first is sent to the bucket of its
   hash; the others are known to start later. A bucket finds the first of all.
3. The starts of all later windows return to their documents, whose covered words go.

Within a chunk equal hashes collapse before the exchange, so a passage that a third of all documents share reaches a bucket once per chunk. No pairs are formed.
Buckets are sorted by Spark (which spills) and read one at a time. Hashes and positions travel as packed columns, a few hundred to a row. The three steps read one
exchange of the texts by document id, which Spark reuses. Nothing is cached: a lost executor's part is computed again from lineage.

Buckets are four for each shuffle partition (that setting is to follow the data, as for any join); one holds its share of the hashes in a worker, about 0.6 bytes for each byte of text.

Defined cases: a null text has no words; rows with a null id are documents of their own that come before all others, in the order of their texts' hashes; rows that share
an id are read as parts of one document, in the order of their texts' hashes, each with its own row in the result; rows equal in id and text are one document and have the same
result; texts of fewer than 20 words lose nothing, texts of any length are read whole; further columns stay, ones with the result's names are replaced; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framequarry.llm._common import row_ids
from framequarry.llm._words import long_word_hashes, pack_ints, pack_sorted, slices, unpack_ints, unpack_sorted, window_hashes, word_hashes

#: A perfect difference cover.
PERIOD, COVER = 13, (0, 1, 3, 9)
#: Words that a task gathers before it sends their anchors.
CHUNK_WORDS = 1_500_000
#: Rows of one id are told apart by bits above those of a position.
PART = 40
_PACKED = "bucket int, h1 binary, h2 binary, docs binary, at binary, known_docs binary, known_at binary"
_NAMES = ["bucket", "h1", "h2", "docs", "at", "known_docs", "known_at"]


def _words(text: str | None) -> list[bytes]:
    return text.encode().split() if text else []


def _first_and_rest(h1: np.ndarray, h2: np.ndarray, docs: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by hash, document and position, each place once; which entries of that order begin a group, and which have an equal neighbour."""
    order = np.lexsort((at, docs, h2, h1))
    a, b = h1[order], h2[order]
    same = (a[1:] == a[:-1]) & (b[1:] == b[:-1])
    again = same & (docs[order[1:]] == docs[order[:-1]]) & (at[order[1:]] == at[order[:-1]])
    if again.any():
        order, same = order[np.concatenate([[True], ~again])], same[~again]
    begins = np.concatenate([[True], ~same]) if len(order) else np.empty(0, bool)
    twice = np.zeros(len(order), bool)
    twice[1:] |= same
    twice[:-1] |= same
    return order, begins, twice


def _dealt(h1, h2, docs, at, known_docs, known_at, buckets: int) -> Iterator[pa.RecordBatch]:
    """Packed rows, one for each bucket; what is already known goes along in equal parts."""
    bucket = (h1 >> np.uint64(33)).astype(np.int64) % buckets
    order = np.lexsort((at, docs, bucket))
    h1, h2, docs, at, bucket = h1[order], h2[order] if len(h2) else h2, docs[order], at[order], bucket[order]
    ends = np.searchsorted(bucket, np.arange(buckets + 1))
    order = np.lexsort((known_at, known_docs))
    known_docs, known_at = known_docs[order], known_at[order]
    cuts = np.linspace(0, len(known_docs), buckets + 1).astype(np.int64)
    rows: list[tuple] = []
    for k in range(buckets):
        i, j, p, q = ends[k], ends[k + 1], cuts[k], cuts[k + 1]
        if i < j or p < q:
            rows.append((k, h1[i:j].tobytes(), h2[i:j].tobytes(), pack_sorted(docs[i:j]), pack_ints(at[i:j]), pack_sorted(known_docs[p:q]), pack_ints(known_at[p:q])))
    if rows:
        kinds = [pa.int32(), *[pa.binary()] * 6]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds, strict=True)], names=_NAMES)


def _runs(docs: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions, sorted by document, as runs of consecutive ones: document, first position, number."""
    begins = np.flatnonzero(np.concatenate([[True], (docs[1:] != docs[:-1]) | (at[1:] != at[:-1] + 1)])) if len(at) else np.empty(0, np.int64)
    return docs[begins], at[begins], np.diff(np.append(begins, len(at)))


def _anchors(length: int, buckets: int) -> Callable:
    """Texts to packed anchors."""
    span = length - PERIOD + 1
    cover = np.array(COVER)

    def send(parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        h, docs, at = (np.concatenate(x) for x in zip(*parts, strict=True))
        none = np.zeros(len(h), np.uint64)
        order, begins, twice = _first_and_rest(h, none, docs, at)
        known, first = order[twice], order[begins]
        yield from _dealt(h[first], none[:0], docs[first], at[first], docs[known], at[known], buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, n, last = [], 0, None
        for b in slices(batches):
            for doc, part, text in zip(b.column("id_").to_pylist(), b.column("part_").to_pylist(), b.column("text_").to_pylist(), strict=True):
                words = _words(text) if (doc, part) != last else []
                last = doc, part
                if len(words) >= length:
                    hashes = window_hashes(word_hashes(words), span)
                    p = (np.arange(0, len(hashes), PERIOD)[:, None] + cover).ravel()
                    p = p[p < len(hashes)]
                    parts.append((hashes[p], np.full(len(p), doc), p + (part << PART)))
                    n += len(words)
            if n >= CHUNK_WORDS:
                yield from send(parts)
                parts, n = [], 0
        if parts:
            yield from send(parts)

    return run


def _buckets_read(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """Rows in the order of their buckets, one bucket at a time."""
    bucket, rows = None, []
    for b in batches:
        for r in b.to_pylist():
            if r["bucket"] != bucket and rows:
                yield rows
                rows = []
            bucket = r["bucket"]
            rows.append(r)
    if rows:
        yield rows


def _joined(rows: list[dict]) -> tuple[np.ndarray, ...]:
    ints = lambda k, f=unpack_ints: np.concatenate([f(r[k]) for r in rows])
    hashes = lambda k: np.frombuffer(b"".join(r[k] for r in rows), np.uint64)
    return hashes("h1"), hashes("h2"), ints("docs", unpack_sorted), ints("at"), ints("known_docs", unpack_sorted), ints("known_at")


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Buckets of anchors to the documents' positions of those that occur twice."""
    for rows in _buckets_read(batches):
        h, _, docs, at, known_docs, known_at = _joined(rows)
        order, _, twice = _first_and_rest(h, np.zeros(len(h), np.uint64), docs, at)
        found = order[twice]
        docs, at = np.concatenate([docs[found], known_docs]), np.concatenate([at[found], known_at])
        yield pa.RecordBatch.from_arrays([pa.array(docs), pa.array(at), pa.array(np.ones(len(at), np.int64))], names=["id_", "at", "n"])


def _later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Buckets of windows to runs of the documents' starts of those that have an earlier copy."""
    for rows in _buckets_read(batches):
        h1, h2, docs, at, known_docs, known_at = _joined(rows)
        order, begins, _ = _first_and_rest(h1, h2, docs, at)
        found = order[~begins]
        docs, at, n = (np.concatenate(x) for x in zip((docs[found], at[found], np.ones(len(found), np.int64)), _runs(known_docs, known_at), strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(docs), pa.array(at), pa.array(n)], names=["id_", "at", "n"])


def _lists(column: pa.ListArray) -> Iterator[np.ndarray]:
    """The rows of a list column as arrays; a null is empty."""
    ends, values = column.offsets.to_numpy(), column.values.to_numpy(zero_copy_only=False)
    return (values[i:j] for i, j in zip(ends[:-1], ends[1:], strict=True))


def _own(at: np.ndarray, n: np.ndarray, part: int) -> np.ndarray:
    """The positions of one row, from runs of all rows of its id."""
    mine = at >> PART == part
    at, n = at[mine] & ((1 << PART) - 1), n[mine]
    return np.repeat(at - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(int(n.sum())) if len(n) else at


def _windows(length: int, buckets: int) -> Callable:
    """Texts with their repeated anchors to packed windows."""

    def send(parts: list[tuple]) -> Iterator[pa.RecordBatch]:
        h1, h2, docs, at = (np.concatenate(x) for x in zip(*parts, strict=True))
        order, begins, _ = _first_and_rest(h1, h2, docs, at)
        first, later = order[begins], order[~begins]
        yield from _dealt(h1[first], h2[first], docs[first], at[first], docs[later], at[later], buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, n, last = [], 0, None
        back = np.arange(PERIOD)
        for b in slices(batches):
            for doc, part, text, at, n_at in zip(*(b.column(c).to_pylist() for c in ("id_", "part_", "text_")), _lists(b.column("at_")), _lists(b.column("n_")), strict=True):
                if (doc, part) == last:
                    continue
                last = doc, part
                at = _own(at, n_at, part)
                words = _words(text) if len(at) else []
                if len(words) >= length:
                    marks = np.zeros(len(words), bool)
                    s = (at[:, None] - back).ravel()
                    marks[s[s >= 0]] = True
                    s = np.flatnonzero(marks[: len(words) - length + 1])
                    h = long_word_hashes(words)
                    parts.append((window_hashes(h[:, 0], length)[s], window_hashes(h[:, 1], length, 1)[s], np.full(len(s), doc), s + (part << PART)))
                    n += len(s)
            if n >= CHUNK_WORDS:
                yield from send(parts)
                parts, n = [], 0
        if parts:
            yield from send(parts)

    return run


def _result(length: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            n_words, n_removed, kept = [], [], []
            for part, text, at, n in zip(*(b.column(c).to_pylist() for c in ("part_", "text_")), _lists(b.column("at_")), _lists(b.column("n_")), strict=True):
                words = _words(text)
                edges = np.zeros(len(words) + 1, np.int64)
                starts = np.unique(_own(at, n, part))
                edges[starts] += 1
                edges[starts + length] -= 1
                stays = np.cumsum(edges)[:-1] == 0
                n_words.append(len(words))
                n_removed.append(len(words) - int(stays.sum()))
                kept.append(b" ".join(words if stays.all() else [w for w, s in zip(words, stays, strict=True) if s]).decode())
            rest = [b.column(i) for i, c in enumerate(b.schema.names) if c not in _OWN]
            names = [c for c in b.schema.names if c not in _OWN]
            yield pa.RecordBatch.from_arrays(
                [*rest, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())], names=[*names, "n_words", "n_removed", "kept_text"]
            )

    return run


_OWN = {"id_", "part_", "text_", "none_", "at_", "n_"}


def substring_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 20) -> DataFrame:
    """df without its text column, with n_words, n_removed and kept_text (the words that stay, joined by single spaces).

    A word goes if a window of `length` words covers it whose words also start earlier: in a smaller id, or before it in the same document.
    """
    if length < PERIOD + 1:
        raise ValueError(f"windows need more than {PERIOD} words")
    spark = df.sparkSession
    buckets = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rest = [c for c in df.columns if c not in {id_col, text_col, "n_words", "n_removed", "kept_text", *_OWN}]
    id_type = df.schema[id_col].dataType
    # without further columns all three steps read the same columns, so Spark exchanges the texts once
    rows = df.select(row_ids(id_col, text_col).alias("id_"), F.col(text_col).alias("text_"), F.col(id_col).isNull().alias("none_"), *rest).repartition("id_")
    texts = rows.withColumn("part_", F.dense_rank().over(Window.partitionBy("id_").orderBy(F.xxhash64("text_"), "text_")).cast("long") - 1)

    def gathered(packed: DataFrame, f: Callable) -> DataFrame:
        found = packed.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(f, "id_ long, at long, n long")
        return found.groupBy("id_").agg(F.collect_list("at").alias("at_"), F.collect_list("n").alias("n_"))

    own = ["id_", "part_", "text_", "none_"]
    anchors = texts.select(own).mapInArrow(_anchors(length, buckets), _PACKED)
    windows = texts.select(own).join(gathered(anchors, _repeated), "id_").select(*own, "at_", "n_").mapInArrow(_windows(length, buckets), _PACKED)
    given = F.when(~F.col("none_"), F.col("id_")).cast(id_type).alias(id_col)
    marked = texts.join(gathered(windows, _later), "id_", "left").select(given, *rest, "part_", "text_", "at_", "n_")
    schema = marked.select(id_col, *rest).schema.add("n_words", "long").add("n_removed", "long").add("kept_text", "string")
    return marked.mapInArrow(_result(length), schema)
