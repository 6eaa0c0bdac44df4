"""Queries of the frame operators over the driver's tables, and their SQL. Every query runs over its whole table and whole payloads."""

from __future__ import annotations

import tempfile
from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framequarry.functions import bytes as fb
from framequarry.functions import frames as fr
from framequarry.functions import parameters as pm
from framequarry.operators import codec, dictionary, gear, offsets, stats, tables
from framequarry.plans.golden import GOLDEN, LEGACY_FRAMES
from framequarry.streaming.chunks import compress_stream, decompress_stream

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def payloads(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """doc_id, payload: the texts as UTF-8 bytes."""
    return table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("payload"), *more)


def dealt_payloads(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    """payloads over tasks for all cores: for coders in Python, and where a task's values would be many."""
    return codec.dealt(payloads(spark, sf_dir, *more), "doc_id", "payload")


def raw_frames(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    return fb.materialized(payloads(spark, sf_dir, *more).withColumn("frame", fr.raw_frame(F.col("payload"))), "frame")


_N = "strlen(coalesce(text, ''))"
#: Bytes of a native raw frame: header (single segment below 256 KiB), blocks, content.
_RAW = f"(5 + CASE WHEN {_N} < 262144 THEN CASE WHEN {_N} < 256 THEN 1 WHEN {_N} < 65792 THEN 2 ELSE 4 END ELSE 5 END + 3 * greatest(1, ceil({_N} / 131072.0)::BIGINT) + {_N})"


@query(f"SELECT lang, count(*) AS n_docs, sum({_N})::BIGINT AS content_bytes, sum({_RAW})::BIGINT AS frame_bytes FROM documents GROUP BY lang")
def frame_sizes_by_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts to frames and back to their headers, by language."""
    docs = fr.with_frame_header(raw_frames(spark, sf_dir, "lang"), "frame", "h")
    return docs.groupBy("lang").agg(F.count("*").alias("n_docs"), F.sum(F.col("h.content_size").cast("bigint")).alias("content_bytes"), F.sum(F.octet_length("frame").cast("bigint")).alias("frame_bytes"))


# Projections

#: Of texts from this many bytes on, frames are smaller.
_SHRINKS = 1000
_TEXT = "SELECT doc_id, coalesce(text, '') AS text FROM documents"
_TEXT_AND_SIZE = f"SELECT doc_id, coalesce(text, '') AS text, {_N} >= {_SHRINKS} AS shrunk FROM documents"


def _shrunk(frame: str = "frame") -> Column:
    return ((F.octet_length("payload") >= _SHRINKS) & (F.octet_length(frame) < 0.8 * F.octet_length("payload"))).alias("shrunk")


def _round_trip(spark: SparkSession, sf_dir: str, options: codec.CompressOptions, back: codec.DecompressOptions | None = None) -> DataFrame:
    """Compressed frames are read back by the decoder; an error would show as a null text. shrunk: whether a long text's frame has less than 0.8 of its bytes."""
    made = dealt_payloads(spark, sf_dir).withColumn("frame", codec.compress("payload", options)["data"])
    return made.select("doc_id", codec.decompress("frame", back)["data"].cast("string").alias("text"), _shrunk())


@query(_TEXT_AND_SIZE)
def roundtrip_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round_trip(spark, sf_dir, codec.CompressOptions())


@query(_TEXT_AND_SIZE)
def roundtrip_checksum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round_trip(spark, sf_dir, codec.CompressOptions(checksum=True))


@query(_TEXT_AND_SIZE)
def roundtrip_long_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round_trip(spark, sf_dir, codec.CompressOptions(ldm=True, window_log=24, content_size=False))


@query(_TEXT_AND_SIZE)
def roundtrip_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each setting of a context given by hand, two workers among them."""
    o = codec.CompressOptions(strategy="lazy2", window_log=18, hash_log=15, chain_log=16, search_log=4, min_match=4, target_length=32, workers=2, job_size=1 << 20, overlap_log=6)
    return _round_trip(spark, sf_dir, o)


@query(_TEXT_AND_SIZE)
def plain_encoder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The library reads what the encoder in Python wrote."""
    return _round_trip(spark, sf_dir, codec.CompressOptions(strategy="lazy", checksum=True, plain=True))


@query(f"SELECT strategy, count(*) AS n_docs, count(*) AS n_equal, 0::BIGINT AS n_errors FROM documents, (VALUES {', '.join(f"('{s}')" for s in pm.STRATEGIES)}) t(strategy) GROUP BY strategy")
def plain_strategies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each parser of the encoder in Python, read back by the library."""
    return _matrix(spark, sf_dir, [(s, codec.CompressOptions(strategy=s, plain=True)) for s in pm.STRATEGIES], "strategy string")


@query(f"SELECT doc_id, CASE WHEN doc_id % 2 = 0 OR {_N} = 64 THEN 'ok' ELSE 'SrcSizeWrong' END AS outcome FROM documents")
def pledged_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pledged size that content does not have is an error."""
    docs = payloads(spark, sf_dir)
    fit = codec.compress(F.when(F.col("doc_id") % 2 != 0, F.col("payload")), codec.CompressOptions(pledged=64))
    return docs.select("doc_id", F.coalesce(fit["error_name"], F.lit("ok")).alias("outcome"))


LEVELS = (-5, 1, 3, 7, 12, 19)


@query("SELECT level, count(*) AS n_docs, count(*) AS n_equal, 0::BIGINT AS n_errors FROM documents, (VALUES (-5), (1), (3), (7), (12), (19)) t(level) GROUP BY level")
def roundtrip_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matrix(spark, sf_dir, [(n, codec.CompressOptions(level=n)) for n in LEVELS], "level int")


@query("SELECT strategy, count(*) AS n_docs, count(*) AS n_equal, 0::BIGINT AS n_errors FROM documents, (VALUES " + ", ".join(f"('{s}')" for s in pm.STRATEGIES) + ") t(strategy) GROUP BY strategy")
def roundtrip_strategies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matrix(spark, sf_dir, [(s, codec.CompressOptions(strategy=s)) for s in pm.STRATEGIES], "strategy string")


def _matrix(spark: SparkSession, sf_dir: str, cases: list[tuple], key: str) -> DataFrame:
    name, kind = key.split()
    out = None
    for value, o in cases:
        back = dealt_payloads(spark, sf_dir).withColumn("r", codec.decompress(codec.compress("payload", o)["data"]))
        one = back.agg(
            F.lit(value).cast(kind).alias(name), F.count("*").alias("n_docs"), F.count_if(F.col("r.data") == F.col("payload")).alias("n_equal"), F.count("r.error_name").alias("n_errors")
        )
        out = one if out is None else out.unionByName(one)
    return out


@query(f"SELECT lang, sum({_N})::BIGINT AS content_bytes, true AS smaller, true AS within_bound FROM documents GROUP BY lang")
def compression_gain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Compressed against plain bytes; no frame goes beyond its bound."""
    made = payloads(spark, sf_dir, "lang").withColumn("frame", codec.compress("payload")["data"])
    n, m = F.octet_length("payload").cast("bigint"), F.octet_length("frame").cast("bigint")
    return made.groupBy("lang").agg(F.sum(n).alias("content_bytes"), (F.sum(m) < F.sum(n)).alias("smaller"), F.every(m <= fr.compress_bound(n) + 32).alias("within_bound"))


_JOB = 4096


@query(f"SELECT doc_id, coalesce(text, '') AS text, 1::BIGINT AS n_frames, {_N}::BIGINT AS declared, {_N} >= {_SHRINKS} AS shrunk FROM documents")
def parallel_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One text as one frame whose blocks are made in parallel, each job seeing an overlap of the bytes before it."""
    docs = payloads(spark, sf_dir)
    made = codec.compress_one_frame(docs, "doc_id", "payload", 4, codec.CompressOptions(strategy="lazy", checksum=True), _JOB)
    found = tables.frames(made.select("doc_id", "frame"), "frame").groupBy("doc_id").agg(F.count("*").alias("n_frames"), F.max("content_size").alias("declared"))
    return made.join(found, "doc_id").join(docs, "doc_id").select("doc_id", codec.decompress("frame")["data"].cast("string").alias("text"), "n_frames", "declared", _shrunk())


@query(_TEXT)
def parallel_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One text as frames made in parallel and put together; decoding reads across them."""
    made = codec.compress_jobs(payloads(spark, sf_dir), "doc_id", "payload", _JOB)
    return made.select("doc_id", codec.decompress("frame")["data"].cast("string").alias("text"))


#: Frames that are put into one buffer.
_TOGETHER = 64


@query(
    "SELECT lang, buffer, string_agg(text, '' ORDER BY doc_id) AS text FROM (SELECT lang, doc_id, coalesce(text, '') AS text, "
    f"(row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1) // {_TOGETHER} AS buffer FROM documents) GROUP BY lang, buffer"
)
def concat_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of a language, with skippable ones between, in buffers of 64 texts that decode to the texts in order."""
    made = payloads(spark, sf_dir, "lang").withColumn("frame", codec.compress("payload")["data"])
    padded = made.select("lang", "doc_id", F.concat("frame", fr.write_skippable_frame(F.encode(F.lit("pad"), "UTF-8"), F.col("doc_id") % 16)).alias("frame"))
    placed = offsets.running_offsets(padded.withColumn("size", F.octet_length("frame")), "lang", "doc_id", "size").withColumn("buffer", F.floor(F.col("ord") / _TOGETHER))
    packed = F.sort_array(F.collect_list(F.struct("doc_id", F.hex("frame").alias("x"))))
    whole = placed.groupBy("lang", "buffer").agg(F.unhex(F.array_join(F.transform(packed, lambda x: x["x"]), "")).alias("frame"))
    return whole.select("lang", "buffer", codec.decompress("frame")["data"].cast("string").alias("text"))


@query(f"SELECT doc_id, ({_N})::BIGINT AS n_bytes, true AS whole FROM documents")
def decode_one_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exactly the first of two frames, and how many bytes it took."""
    made = payloads(spark, sf_dir).withColumn("frame", codec.compress("payload")["data"])
    r = codec.decompress_frame(F.concat("frame", "frame"))
    return made.withColumn("r", r).select("doc_id", F.octet_length("r.data").cast("bigint").alias("n_bytes"), (F.col("r.consumed") == F.octet_length("frame")).alias("whole"))


@query(f"SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'ok' ELSE 'DstSizeTooSmall' END AS compressing, CASE WHEN doc_id % 2 = 0 OR {_N} = 0 THEN 'ok' ELSE 'DstSizeTooSmall' END AS decoding FROM documents")
def bounded_buffers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Room of exactly the bound, and of one byte less."""
    n = F.octet_length("payload").cast("bigint")
    less = F.col("doc_id") % 2
    docs = payloads(spark, sf_dir).withColumn("frame", codec.compress("payload")["data"])
    docs = docs.withColumn("c", codec.compress_into(F.col("payload"), fr.compress_bound(n) - less)).withColumn("d", codec.decompress_into(F.col("frame"), F.greatest(n - less, F.lit(0))))
    return docs.select("doc_id", F.coalesce("c.error_name", F.lit("ok")).alias("compressing"), F.coalesce("d.error_name", F.lit("ok")).alias("decoding"))


# Predicates and headers


@query(
    "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'zstd' WHEN 1 THEN 'skippable' WHEN 2 THEN 'legacy' ELSE 'unknown' END AS kind, doc_id % 4 <> 3 AS is_frame, "
    "CASE WHEN doc_id % 4 = 2 THEN (doc_id // 4 % 7 + 1)::INTEGER END AS legacy_version FROM documents"
)
def frame_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    legacy = F.element_at(F.array(*[F.unhex(F.lit(m)) for m in fr.LEGACY]), (F.floor(F.col("doc_id") / 4) % 7 + 1).cast("int"))
    b = (
        F.when(F.col("doc_id") % 4 == 0, F.col("frame"))
        .when(F.col("doc_id") % 4 == 1, fr.write_skippable_frame(F.col("payload"), F.col("doc_id") % 16))
        .when(F.col("doc_id") % 4 == 2, F.concat(legacy, "payload"))
        .otherwise(F.substring("payload", 1, 3))
    )
    docs = raw_frames(spark, sf_dir).select("doc_id", b.alias("b"))
    return docs.select("doc_id", fr.detect_frame(F.col("b")).alias("kind"), fr.is_frame(F.col("b")).alias("is_frame"), fr.legacy_version(F.col("b")).alias("legacy_version"))


@query(
    f"SELECT doc_id, {_N} < 262144 AS single_segment, {_N}::BIGINT AS content_size, CASE WHEN {_N} < 262144 THEN {_N} ELSE (1::BIGINT << floor(log2({_N}))::INTEGER) END::BIGINT AS window_size, "
    f"({_RAW} - {_N} - 3 * greatest(1, ceil({_N} / 131072.0)))::BIGINT AS header_size, least({_N}, 131072)::BIGINT AS block_size_max FROM documents"
)
def raw_frame_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = fr.with_frame_header(raw_frames(spark, sf_dir), "frame", "h").select("doc_id", "h", fb.byte_at(F.col("frame"), 4).alias("flags"))
    return docs.select(
        "doc_id",
        (F.col("flags").bitwiseAND(32) != 0).alias("single_segment"),
        F.col("h.content_size").cast("bigint").alias("content_size"),
        F.col("h.window_size").cast("bigint").alias("window_size"),
        F.col("h.header_size").alias("header_size"),
        F.col("h.block_size_max").alias("block_size_max"),
    )


@query(
    f"WITH c AS (SELECT doc_id, single, dict_id, {_N}::BIGINT * {_N} * 37 AS n, 10 + {_N} % 15 AS log FROM documents, (VALUES (true), (false)) s(single), (VALUES (0), (200), (300), (70000)) d(dict_id)) "
    "SELECT doc_id, single, dict_id::BIGINT AS dict_id, log % 2 = 1 AS checksum, (CASE WHEN single THEN n ELSE 1::BIGINT << log::INTEGER END)::BIGINT AS window_size, n::BIGINT AS content_size FROM c"
)
def header_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers of all widths of sizes and ids, written and read back; sizes and windows are made of the texts' lengths."""
    docs = payloads(spark, sf_dir).select("doc_id", F.octet_length("payload").cast("bigint").alias("k"))
    cases = docs.select("*", F.explode(F.array(F.lit(True), F.lit(False))).alias("single")).select("*", F.explode(F.array(*[F.lit(x).cast("bigint") for x in (0, 200, 300, 70000)])).alias("dict_id"))
    log = F.col("k") % 15 + 10
    head = fr.write_frame_header(F.col("k") * F.col("k") * 37, F.pow(F.lit(2), log).cast("bigint"), F.col("dict_id"), log % 2 == 1, F.col("single"))
    h = fr.with_frame_header(fb.materialized(cases.withColumn("head", head), "head"), "head", "h")
    return h.select(
        "doc_id",
        "single",
        F.col("h.dict_id").alias("dict_id"),
        F.col("h.checksum_flag").alias("checksum"),
        F.col("h.window_size").cast("bigint").alias("window_size"),
        F.col("h.content_size").cast("bigint").alias("content_size"),
    )


@query(f"SELECT doc_id, (doc_id % 16)::BIGINT AS variant, hex(encode(coalesce(text, ''))) AS payload, ({_N} + 8)::BIGINT AS total_size FROM documents")
def skippable_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = payloads(spark, sf_dir).withColumn("b", fr.write_skippable_frame(F.col("payload"), F.col("doc_id") % 16))
    return docs.select(
        "doc_id", fr.frame_header(F.col("b"))["dict_id"].alias("variant"), F.hex(fr.read_skippable_frame(F.col("b"))).alias("payload"), fr.skippable_frame_size(F.col("b")).alias("total_size")
    )


@query(f"SELECT doc_id FROM documents WHERE {_N} <= 2048")
def window_limit_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames within a window, by their headers alone."""
    return codec.guarded(raw_frames(spark, sf_dir), "frame", 2048).select("doc_id")


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'ok' WHEN doc_id % 3 = 1 THEN 'ok' ELSE 'DictionaryWrong' END AS outcome FROM documents")
def dict_id_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames without an id, with the supplied dictionary's and with another."""
    n = F.octet_length("payload").cast("bigint")
    dict_id = F.when(F.col("doc_id") % 3 == 0, 0).when(F.col("doc_id") % 3 == 1, 77).otherwise(78)
    head = fr.write_frame_header(n, F.greatest(n, F.lit(1024)), dict_id, F.lit(False), n < 256 * 1024)
    docs = fr.with_frame_header(raw_frames(spark, sf_dir), "frame", "h").withColumn("size", F.col("h.header_size"))
    frame = F.concat(head, fb.part(F.col("frame"), F.col("size"), F.octet_length("frame")))
    docs = fb.materialized(docs.select("doc_id", frame.alias("frame")), "frame")
    r = codec.decompress("frame", codec.DecompressOptions(dictionary=b"some dictionary content", dict_id=77))
    return docs.select("doc_id", F.coalesce(r["error_name"], F.lit("ok")).alias("outcome"))


@query(
    "SELECT doc_id, n > 0 AND h = repeat(substr(h, 1, 2), n) AS uniform, n > 0 AS run_uniform, n > 0 AND h = repeat(substr(h, 1, 2), n) AS twice_uniform "
    f"FROM (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, {_N} AS n FROM documents)"
)
def uniform_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts, runs of their first byte as long as they are, and texts doubled."""
    docs = payloads(spark, sf_dir).withColumn("run", F.unhex(F.repeat(F.substring(F.hex("payload"), 1, 2), F.octet_length("payload"))))
    return docs.select("doc_id", stats.is_uniform(F.col("payload")).alias("uniform"), stats.is_uniform(F.col("run")).alias("run_uniform"), stats.is_uniform(F.concat("payload", "payload")).alias("twice_uniform"))


@query(
    f"SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '{fr.CONTENT_ERROR}' WHEN 1 THEN '0' ELSE {_N}::VARCHAR END AS content_size, "
    f"CASE WHEN doc_id % 3 < 2 THEN '0' WHEN {_N} < 262144 THEN {_N}::VARCHAR ELSE (1::BIGINT << floor(log2({_N}))::INTEGER)::VARCHAR END AS window_size, 0::BIGINT AS dict_id, "
    f"doc_id % 3 = 2 AND {_N} > 0 AS found_at_offset FROM documents"
)
def frame_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes, windows and ids that never fail, of broken, skippable and regular frames; and a frame's header read at its offset in a buffer."""
    k = F.col("doc_id") % 3
    b = F.when(k == 0, F.unhex(F.lit("00112233"))).when(k == 1, fr.write_skippable_frame(F.col("payload"), F.lit(5))).otherwise(F.col("frame"))
    docs = fb.materialized(raw_frames(spark, sf_dir).withColumn("b", b), "b").withColumn("whole", F.concat("payload", "b"))
    docs = fb.materialized(docs, "whole").withColumn("at", fr.frame_header_at(F.col("whole"), F.octet_length("payload")))
    return docs.select(
        "doc_id",
        fr.frame_content_size(F.col("b")).cast("string").alias("content_size"),
        fr.frame_window_size(F.col("b")).cast("string").alias("window_size"),
        fr.dictionary_id(F.col("b")).alias("dict_id"),
        F.coalesce((F.col("at.frame_type") == "regular") & (F.col("at.content_size") == F.octet_length("payload")) & (F.octet_length("payload") > 0), F.lit(False)).alias("found_at_offset"),
    )


@query(
    "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'ContentSizeMismatch' WHEN 1 THEN 'DictionaryWrong' WHEN 2 THEN 'DstSizeTooSmall' ELSE 'WindowTooLarge' END AS error_name, "
    "CASE doc_id % 4 WHEN 0 THEN 'content_size_mismatch' WHEN 1 THEN 'dictionary_wrong' WHEN 2 THEN 'dstSize_tooSmall' ELSE 'windowTooLarge' END AS error_text FROM documents"
)
def refused_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames that declare another size, want a dictionary, give more than is allowed or ask for too large a window."""
    n = F.octet_length("payload").cast("bigint")
    k = F.col("doc_id") % 4
    docs = fr.with_frame_header(raw_frames(spark, sf_dir), "frame", "h").withColumn("size", F.col("h.header_size"))
    head = F.when(k == 3, fr.write_frame_header(n, F.lit(1 << 28), F.lit(0), F.lit(False), F.lit(False))).otherwise(fr.write_frame_header(n + 1, F.greatest(n, F.lit(1024)), F.lit(0), F.lit(False), n + 1 < 256 * 1024))
    frame = F.when(k % 3 == 0, F.concat(head, fb.part(F.col("frame"), F.col("size"), F.octet_length("frame")))).when(k == 2, F.concat("frame", F.unhex(F.lit("28b52ffda0000001000300080078")))).otherwise(F.col("frame"))
    docs = fb.materialized(docs.select("doc_id", frame.alias("frame")), "frame")
    needs = codec.decompress(F.when(k == 1, F.col("frame")), codec.DecompressOptions(require_dictionary=True))
    small = codec.decompress(F.when(k == 2, F.col("frame")), codec.DecompressOptions(max_output=64 << 10))
    rest = codec.decompress(F.when(k % 3 == 0, F.col("frame")))
    error = F.coalesce(needs["error_name"], small["error_name"], rest["error_name"])
    return docs.select("doc_id", error.alias("error_name")).select("doc_id", "error_name", codec.error_text(F.col("error_name")).alias("error_text"))


# Table functions


@query(
    f"SELECT lang, doc_id, {_RAW}::BIGINT AS total_size, coalesce(sum({_RAW}) OVER (PARTITION BY lang ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_at, "
    "(row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1)::INTEGER AS ord FROM documents"
)
def frame_iter_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of a language, in order, in buffers of about 16 MiB: what the iterator finds in each, with the offsets that the frames have in all buffers together."""
    made = raw_frames(spark, sf_dir, "lang").drop("payload").withColumn("size", F.octet_length("frame"))
    placed = offsets.running_offsets(made, "lang", "doc_id", "size").withColumn("buffer", F.floor(F.col("start_at") / (16 << 20)))
    packed = F.sort_array(F.collect_list(F.struct("doc_id", F.hex("frame").alias("x"))))
    whole = placed.groupBy("lang", "buffer").agg(
        F.unhex(F.array_join(F.transform(packed, lambda x: x["x"]), "")).alias("frame"),
        F.sort_array(F.collect_list("doc_id")).alias("ids"),
        F.min("start_at").alias("first_at"),
        F.min("ord").alias("first_ord"),
    )
    found = tables.frame_lists(whole, "frame").select("lang", "first_at", "first_ord", F.explode(F.arrays_zip("ids", "frames")).alias("x"))
    return found.select(
        "lang",
        F.col("x.ids").alias("doc_id"),
        F.col("x.frames.total_size").alias("total_size"),
        (F.col("first_at") + F.col("x.frames.offset")).alias("start_at"),
        (F.col("first_ord") + F.col("x.frames.ord")).cast("int").alias("ord"),
    )


_BIG = "strlen(repeat(coalesce(text, ''), 20))"


@query(
    f"SELECT doc_id, i::INTEGER AS ord, least(131072, n - i * 131072)::BIGINT AS size, i = k - 1 AS last FROM (SELECT doc_id, n, k, unnest(range(k)) AS i FROM "
    f"(SELECT doc_id, {_BIG} AS n, greatest(1, ceil({_BIG} / 131072.0)::BIGINT) AS k FROM documents))"
)
def block_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of 128 KiB of texts repeated twenty times."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.repeat(F.coalesce("text", F.lit("")), F.lit(20)).cast("binary").alias("payload"))
    return tables.blocks(docs.select("doc_id", fr.raw_frame(F.col("payload")).alias("frame")), "frame").select("doc_id", "ord", "size", "last")


@query(f"SELECT doc_id, (2 * {_N})::BIGINT AS bound FROM documents")
def decompress_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bound of two frames with a skippable one between."""
    docs = raw_frames(spark, sf_dir).select("doc_id", F.concat("frame", fr.write_skippable_frame(F.col("payload"), F.lit(3)), "frame").alias("b"))
    return tables.decompress_bound(docs, "b").select("doc_id", "bound")


@query(f"SELECT doc_id, {_N}::BIGINT AS bound FROM documents")
def unknown_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bound of frames without a declared size is that of their blocks."""
    docs = fr.with_frame_header(raw_frames(spark, sf_dir), "frame", "h").withColumn("size", F.col("h.header_size"))
    head = fr.write_frame_header(None, F.lit(1 << 17), F.lit(0), F.lit(False), F.lit(False))
    docs = docs.select("doc_id", F.concat(head, fb.part(F.col("frame"), F.col("size"), F.octet_length("frame"))).alias("b"))
    return tables.decompress_bound(docs, "b").select("doc_id", "bound")


@query(f"SELECT doc_id, 'regular' AS kind, {_RAW}::BIGINT AS total_size, {_N}::BIGINT AS content_size FROM documents")
def inspect_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first frame of a buffer, whatever follows it."""
    docs = raw_frames(spark, sf_dir).select("doc_id", F.concat("frame", "payload").alias("b"))
    return tables.inspect_frames(docs, "b").select("doc_id", "kind", "total_size", "content_size")


@query(f"SELECT doc_id, count(*) AS n_frames, sum({_RAW})::BIGINT AS total FROM documents GROUP BY doc_id")
def lateral_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The SQL table function."""
    tables.register(spark)
    raw_frames(spark, sf_dir).select("doc_id", "frame").createOrReplaceTempView("fq_raw_frames")
    return spark.sql("SELECT doc_id, count(*) AS n_frames, sum(f.total_size) AS total FROM fq_raw_frames, LATERAL fq_frames(frame) f GROUP BY doc_id")


@query("SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN NULL WHEN 1 THEN 'SrcSizeWrong' WHEN 2 THEN 'PrefixUnknown' WHEN 3 THEN 'ChecksumWrong' ELSE 'FrameParameterUnsupported' END AS error_name FROM documents")
def corrupt_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole, cut-off, misnamed, damaged and reserved-bit frames by their errors."""
    frame = F.col("frame")
    n = F.octet_length(frame)
    flags = fb.write_le(fb.byte_at(frame, 4).bitwiseOR(8), 1)
    last = fb.write_le(fb.byte_at(frame, n - 1).bitwiseXOR(1), 1)
    k = F.col("doc_id") % 5
    b = (
        F.when(k == 1, fb.part(frame, 0, n - 1))
        .when(k == 2, F.concat(F.unhex(F.lit("29B52FFD")), fb.part(frame, 4, n - 4)))
        .when(k == 3, F.concat(fb.part(frame, 0, n - 1), last))
        .when(k == 4, F.concat(fb.part(frame, 0, 4), flags, fb.part(frame, 5, n - 5)))
        .otherwise(frame)
    )
    docs = payloads(spark, sf_dir).withColumn("frame", codec.compress("payload", codec.CompressOptions(checksum=True))["data"]).select("doc_id", b.alias("b"))
    return docs.select("doc_id", codec.decompress("b")["error_name"].alias("error_name"))


@query("SELECT doc_id, true AS same FROM documents")
def checksum_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A frame's last four bytes against XXH64 of its content."""
    docs = payloads(spark, sf_dir).withColumn("frame", codec.compress("payload", codec.CompressOptions(checksum=True))["data"])
    tail = fb.read_le(F.col("frame"), F.octet_length("frame") - 4, 4)
    return docs.select("doc_id", (codec.checksum("payload") == tail).alias("same"))


@query("SELECT name, expect_ok AS ok, expect_len AS n_bytes FROM (VALUES " + ", ".join(f"('{n}', {str(k is not None).lower()}, {'NULL' if k is None else k}::BIGINT)" for n, _, k in GOLDEN) + ") t(name, expect_ok, expect_len)")
def golden_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known frames decode to known lengths; malformed ones are refused."""
    rows = spark.createDataFrame([(n, bytearray.fromhex(h)) for n, h, _ in GOLDEN], "name string, frame binary").withColumn("r", codec.decompress("frame"))
    return rows.select("name", F.col("r.error_name").isNull().alias("ok"), F.octet_length("r.data").cast("bigint").alias("n_bytes"))


@query(_TEXT_AND_SIZE)
def plain_decoder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The decoder in Python reads what the library wrote."""
    return _round_trip(spark, sf_dir, codec.CompressOptions(level=6, checksum=True), codec.DecompressOptions(plain=True))


@query("SELECT version, 239::BIGINT AS n_bytes, NULL::VARCHAR AS error_name FROM range(1, 8) t(version)")
def legacy_golden(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Historic frames of all seven versions decode to one text."""
    rows = spark.createDataFrame([(v, bytearray.fromhex(h)) for v, h in LEGACY_FRAMES.items()], "version bigint, frame binary").withColumn("r", codec.decompress("frame"))
    return rows.select("version", F.octet_length("r.data").cast("bigint").alias("n_bytes"), F.col("r.error_name").alias("error_name"))


@query("SELECT version, count(*) AS n_docs, count(*) AS n_equal, 0::BIGINT AS n_errors FROM documents, (VALUES (2), (3), (4), (5)) t(version) GROUP BY version")
def legacy_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text written as frames of each of the versions 0.2 to 0.5, and read back."""
    out = None
    for v in codec.HISTORIC_WRITTEN:
        back = dealt_payloads(spark, sf_dir).withColumn("r", codec.decompress(codec.compress_historic("payload", v)["data"]))
        one = back.agg(F.lit(v).alias("version"), F.count("*").alias("n_docs"), F.count_if(F.col("r.data") == F.col("payload")).alias("n_equal"), F.count("r.error_name").alias("n_errors"))
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT version, n_bytes, true AS decodes FROM (VALUES " + ", ".join(f"({v}, {len(h) // 2}::BIGINT)" for v, h in LEGACY_FRAMES.items()) + ") t(version, n_bytes)")
def legacy_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Historic frames are told apart by their first bytes."""
    rows = spark.createDataFrame([(bytearray.fromhex(h),) for h in LEGACY_FRAMES.values()], "frame binary")
    version = fr.legacy_version(F.col("frame"))
    return rows.select(version.alias("version"), F.octet_length("frame").cast("bigint").alias("n_bytes"), fr.supports_decode(version).alias("decodes"))


# Parameters


@query(f"SELECT doc_id, ({_N} + ({_N} >> 8) + CASE WHEN {_N} < 131072 THEN (131072 - {_N}) >> 11 ELSE 0 END)::BIGINT AS bound FROM documents")
def compress_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    return payloads(spark, sf_dir).select("doc_id", fr.compress_bound(F.octet_length("payload")).alias("bound"))


def _level_sql() -> str:
    rows = ", ".join(str(r) for r in pm.level_table())
    return f"""
WITH p(size_class, row, w, c, h, s, m, t, g) AS (VALUES {rows}),
k AS (SELECT doc_id, {_N}::BIGINT AS n, level FROM documents, (VALUES (-7), (0), (1), (3), (9), (15), (22), (40)) v(level)),
j AS (SELECT *, CASE WHEN n <= 16384 THEN 3 WHEN n <= 131072 THEN 2 WHEN n <= 262144 THEN 1 ELSE 0 END AS sc, CASE WHEN level = 0 THEN 3 WHEN level < 0 THEN 0 ELSE least(level, 22) END AS r FROM k)
SELECT doc_id, level, CASE WHEN n > 0 THEN least(w, greatest(10, CASE WHEN n <= 1 THEN 0 ELSE length(bin(n - 1)) END)) ELSE w END::INTEGER AS window_log, c AS chain_log, h AS hash_log, s AS search_log,
  m AS min_match, CASE WHEN level < 0 THEN -level ELSE t END AS target_length, ({list(pm.STRATEGIES)})[g] AS strategy
FROM j JOIN p ON size_class = sc AND row = r"""


@query(_level_sql())
def level_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = payloads(spark, sf_dir).select("doc_id", F.octet_length("payload").cast("bigint").alias("n"), F.explode(F.array(*[F.lit(x) for x in (-7, 0, 1, 3, 9, 15, 22, 40)])).alias("level"))
    out = pm.with_level_parameters(docs, "level", "n")
    return out.select("doc_id", "level", F.col("window_log").cast("int").alias("window_log"), "chain_log", "hash_log", "search_log", "min_match", "target_length", "strategy")


@query(
    "SELECT level, CASE WHEN level <= 1 THEN 'fast' WHEN level <= 3 THEN 'dfast' WHEN level <= 5 THEN 'greedy' WHEN level <= 7 THEN 'lazy' WHEN level <= 9 THEN 'lazy2' WHEN level <= 12 THEN 'btlazy2' "
    "WHEN level <= 15 THEN 'btopt' WHEN level <= 18 THEN 'btultra' ELSE 'btultra2' END AS strategy FROM range(-5, 23) t(level)"
)
def strategy_from_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.range(-5, 23).select(F.col("id").alias("level"), pm.strategy_from_level(F.col("id")).alias("strategy"))


_PLAN_CASES = "(VALUES (0), (11), (20), (27)) w(window_log), (VALUES (false), (true)) l(ldm)"


@query(
    f"WITH a AS (SELECT doc_id, {_N}::BIGINT AS n, window_log, ldm, CASE WHEN window_log > 0 THEN 1::BIGINT << window_log ELSE greatest({_N}, 1024) END::BIGINT AS declared FROM documents, {_PLAN_CASES}), "
    "b AS (SELECT *, declared >= n AND n < 262144 AS single FROM a), c AS (SELECT *, CASE WHEN single THEN greatest(declared, 1024) WHEN ldm THEN greatest(declared, 1048576) ELSE declared END AS win FROM b) "
    "SELECT doc_id, window_log, ldm, single AS single_segment, win::BIGINT AS window_size, least(1::BIGINT << (length(bin(win)) - 1)::INTEGER, 67108864)::BIGINT AS history_limit FROM c"
)
def frame_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = payloads(spark, sf_dir).select("doc_id", F.octet_length("payload").alias("n"), F.explode(F.array(*[F.lit(x) for x in (0, 11, 20, 27)])).alias("window_log"))
    docs = docs.withColumn("ldm", F.explode(F.array(F.lit(False), F.lit(True))))
    return pm.with_frame_plan(docs, F.col("n"), F.col("window_log"), F.col("ldm"), F.lit(0), "p").select("doc_id", "window_log", "ldm", "p.single_segment", "p.window_size", "p.history_limit")


@query(
    "WITH a AS (SELECT o_orderkey AS k, (o_orderkey * 7919 % 50000000)::BIGINT AS n, threads FROM orders, (VALUES (1), (4), (16)) t(threads)), "
    "b AS (SELECT *, least(CASE WHEN n = 0 THEN 1 ELSE (n + 524287) // 524288 END, threads * 2) AS j0, least(1::BIGINT << (length(bin(greatest(n, 1024))) - 1)::INTEGER, 67108864) AS hist FROM a), "
    "c AS (SELECT *, CASE WHEN j0 > 1 THEN hist // 8 ELSE 0 END AS ov, CASE WHEN j0 <= 1 THEN n ELSE (n + j0 - 1) // j0 END AS s0 FROM b), "
    "d AS (SELECT *, CASE WHEN j0 > 1 AND s0 < ov THEN (n + ov - 1) // ov ELSE j0 END AS j, greatest(s0, ov) AS s FROM c) "
    "SELECT k, threads, j::BIGINT AS num_jobs, s::BIGINT AS job_size, ov::BIGINT AS overlap FROM d"
)
def job_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), (F.col("o_orderkey") * 7919 % 50000000).alias("n"), F.explode(F.array(F.lit(1), F.lit(4), F.lit(16))).alias("threads"))
    planned = pm.with_frame_plan(docs, F.col("n"), F.lit(0), F.lit(False), F.lit(0))
    s = pm.with_job_split(planned, F.col("n"), F.col("threads"), F.lit("fast"), "plan", F.lit(False), "s")
    return s.select("k", "threads", "s.num_jobs", "s.job_size", "s.overlap")


@query(
    "WITH a AS (SELECT w, g, h, CASE WHEN h > 0 THEN greatest(w - h, 0) ELSE 7 - g // 3 END AS r FROM range(10, 32) x(w), range(1, 10) y(g), (VALUES (0), (17), (25)) z(h)), "
    "b AS (SELECT *, CASE WHEN w <= r THEN 6 ELSE greatest(6, least(30, w - r)) END AS t FROM a) "
    "SELECT w AS window_log, g AS strategy, h AS hash_in, greatest(r, 1)::INTEGER AS hash_rate_log, t::INTEGER AS hash_log, CASE WHEN g >= 8 THEN 32 ELSE 64 END AS min_match, "
    "least(greatest(4, least(8, g)), t)::INTEGER AS bucket_size_log, (8 * (1::BIGINT << t::INTEGER) + (1::BIGINT << (t - least(greatest(4, least(8, g)), t))::INTEGER))::BIGINT AS table_size FROM b"
)
def ldm_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = spark.range(10, 32).select(F.col("id").alias("window_log"), F.explode(F.sequence(F.expr("1L"), F.expr("9L"))).alias("strategy"))
    cases = cases.withColumn("hash_in", F.explode(F.array(F.lit(0), F.lit(17), F.lit(25))))
    out = cases.withColumn("s", pm.adjust_ldm(F.col("window_log"), F.col("strategy"), F.col("hash_in")))
    return out.select("window_log", "strategy", "hash_in", "s.*", pm.ldm_table_size(F.col("s.hash_log"), F.col("s.bucket_size_log")).alias("table_size"))


@query(
    "SELECT strategy, CASE WHEN k < 2 THEN 'hash_table' WHEN k < 5 THEN 'hash_chain' ELSE 'binary_tree' END AS finder, CASE WHEN k < 3 THEN 0 WHEN k = 3 THEN 1 ELSE 2 END AS lazy_steps, "
    "CASE WHEN k = 8 THEN 9 WHEN k >= 6 THEN 8 WHEN k >= 4 THEN 7 ELSE 6 END AS overlap_log "
    f"FROM (SELECT unnest({list(pm.STRATEGIES)}) AS strategy, generate_subscripts({list(pm.STRATEGIES)}, 1) - 1 AS k)"
)
def strategy_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.range(1).select(F.explode(F.array(*[F.lit(s) for s in pm.STRATEGIES])).alias("strategy"))
    return rows.select("strategy", pm.search_settings(F.col("strategy"))["finder"].alias("finder"), pm.search_settings(F.col("strategy"))["lazy_steps"].alias("lazy_steps"), pm.overlap_log(F.col("strategy")).alias("overlap_log"))


@query("SELECT w AS window_log, CASE WHEN w > 0 AND w < 31 THEN 1::BIGINT << w::INTEGER END AS most FROM range(0, 33) t(w)")
def distance_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.range(0, 33).select(F.col("id").alias("window_log"), pm.window_limit(F.col("id")).alias("most"))


@query(f"SELECT '{fr.FORMAT_VERSION}' AS format_version, {fr.FORMAT_VERSION_NUMBER} AS format_number, -131072 AS least_level, 22 AS most_level, 3 AS default_level")
def versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = {"format_version": fr.FORMAT_VERSION, "format_number": fr.FORMAT_VERSION_NUMBER, "least_level": pm.LEVEL_MIN, "most_level": pm.LEVEL_MAX, "default_level": pm.LEVEL_DEFAULT}
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in given.items()])


def _codes_sql() -> str:
    base = lambda name, bases: f"{name}(code, base) AS (VALUES {', '.join(f'({i}, {b})' for i, b in enumerate(bases))})"
    return f"""WITH {base("ll", pm.LL_BASE)}, {base("ml", pm.ML_BASE)}, d AS (SELECT doc_id, {_N}::BIGINT AS n FROM documents)
SELECT doc_id, (SELECT max(code) FROM ll WHERE base <= n)::INTEGER AS ll_code, (SELECT max(code) FROM ml WHERE base <= n + 3)::INTEGER AS ml_code,
  CASE WHEN n >= 4 THEN length(bin(n + 3)) - 1 END::INTEGER AS offset_code FROM d"""


@query(_codes_sql())
def length_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.octet_length("payload").cast("bigint")
    return payloads(spark, sf_dir).select("doc_id", pm.literal_length_code(n).alias("ll_code"), pm.match_length_code(n + 3).alias("ml_code"), pm.offset_code(n).alias("offset_code"))


@query(
    "SELECT event_id, length(bin(event_id + 1)) - 1 AS high_bit, 31 - (length(bin(event_id + 1)) - 1) AS leading_zeros, bit_count(((event_id + 1) & -(event_id + 1)) - 1)::INTEGER AS trailing_zeros, "
    "(((((event_id * 2654435761) & 4294967295) << 13) | (((event_id * 2654435761) & 4294967295) >> 19)) & 4294967295)::BIGINT AS rotated FROM events"
)
def bit_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("event_id") + 1
    return table(spark, sf_dir, "events").select(
        "event_id", fb.high_bit(x).alias("high_bit"), fb.leading_zeros32(x).alias("leading_zeros"), fb.trailing_zeros(x).alias("trailing_zeros"), fb.rotate_left32(F.col("event_id") * 2654435761, 13).alias("rotated")
    )


# Statistics

_BYTES = "SELECT lang, ('0x' || substr(h, 2 * i + 1, 2))::INTEGER AS symbol FROM (SELECT lang, h, unnest(range(length(h) // 2)) AS i FROM (SELECT lang, hex(encode(coalesce(text, ''))) AS h FROM documents))"


def _histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.byte_histogram(payloads(spark, sf_dir, "lang"), "payload", ["lang"])


@query(f"SELECT lang, symbol, count(*) AS n FROM ({_BYTES}) GROUP BY lang, symbol")
def byte_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _histogram(spark, sf_dir)


@query(
    f"SELECT lang, count(*) AS cardinality, max(n)::BIGINT AS largest, sum(n)::BIGINT AS total, max(symbol) AS max_symbol, round(sum(-n / t * log2(n / t)), 6) AS entropy "
    f"FROM (SELECT *, sum(n) OVER (PARTITION BY lang)::DOUBLE AS t FROM (SELECT lang, symbol, count(*)::DOUBLE AS n FROM ({_BYTES}) GROUP BY lang, symbol)) GROUP BY lang"
)
def byte_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.histogram_facts(_histogram(spark, sf_dir), ["lang"]).withColumn("entropy", F.round("entropy", 6))


@query(
    f"WITH h AS (SELECT lang, symbol, count(*) AS n FROM ({_BYTES}) GROUP BY lang, symbol), "
    "f AS (SELECT *, sum(n) OVER (PARTITION BY lang)::HUGEINT AS total, count(*) OVER (PARTITION BY lang)::HUGEINT AS k FROM h), "
    "s AS (SELECT *, n * (2048 - k) // total AS whole, n * (2048 - k) % total AS rest FROM f), "
    "p AS (SELECT *, 2048 - k - sum(whole) OVER (PARTITION BY lang) AS over, row_number() OVER (PARTITION BY lang ORDER BY rest DESC, symbol) AS place FROM s) "
    "SELECT lang, symbol, n, (1 + whole + CASE WHEN place <= over THEN 1 ELSE 0 END)::BIGINT AS value FROM p"
)
def normalized_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.normalized_counts(_histogram(spark, sf_dir), ["lang"], 11)


@query("SELECT lang, 2048::BIGINT AS kraft, true AS in_depth, true AS near_entropy FROM documents GROUP BY lang HAVING sum(strlen(coalesce(text, ''))) > 0")
def huffman_kraft(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code lengths that use the whole code space, within a bit a byte of the entropy."""
    histogram = _histogram(spark, sf_dir)
    lengths = stats.huffman_lengths(histogram, ["lang"])
    out = stats.payload_bytes(lengths, ["lang"]).join(stats.histogram_facts(histogram, ["lang"]), "lang").join(lengths.groupBy("lang").agg(F.max("value").alias("deepest")), "lang")
    bits = F.col("payload_bytes") * 8 / F.col("total")
    return out.select("lang", "kraft", (F.col("deepest") <= stats.CODE_DEPTH).alias("in_depth"), ((bits >= F.col("entropy") - 1e-9) & (bits < F.col("entropy") + 1)).alias("near_entropy"))


@query(f"SELECT lang, symbol, n, row_number() OVER (PARTITION BY lang ORDER BY n DESC, symbol)::INTEGER AS place FROM (SELECT lang, symbol, count(*) AS n FROM ({_BYTES}) GROUP BY lang, symbol)")
def symbol_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.symbol_order(_histogram(spark, sf_dir), ["lang"])


@query(
    f"WITH h AS (SELECT lang, symbol, count(*) AS n FROM ({_BYTES}) GROUP BY lang, symbol), f AS (SELECT lang, sum(n)::BIGINT AS total, max(symbol)::BIGINT AS top FROM h GROUP BY lang), "
    "b AS (SELECT *, length(bin(total)) AS bt, CASE WHEN total > 1 THEN length(bin(total - 1)) ELSE 0 END AS bm, CASE WHEN top > 0 THEN length(bin(top)) ELSE 0 END AS bs FROM f) "
    "SELECT lang, total, CASE WHEN total <= 1 THEN 5 ELSE greatest(5, least(12, greatest(least(11, greatest(bm - 3, 0)), least(bt, bs + 1)))) END::INTEGER AS table_log FROM b"
)
def table_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = stats.histogram_facts(_histogram(spark, sf_dir), ["lang"])
    return facts.select("lang", "total", stats.table_log(F.col("total"), F.col("max_symbol").cast("long")).cast("int").alias("table_log"))


@query(f"SELECT lang, symbol, floor(4 * log2(sum(n) OVER (PARTITION BY lang)::DOUBLE / n) + 1e-9)::BIGINT AS price FROM (SELECT lang, symbol, count(*) AS n FROM ({_BYTES}) GROUP BY lang, symbol)")
def symbol_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.symbol_prices(_histogram(spark, sf_dir), ["lang"]).select("lang", "symbol", "price")


# Dictionaries: samples are the benchmark's texts

K, D, SIZE = 6, 32, 4096
_SAMPLES = "SELECT item_id AS sample, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM benchmark"


def _cover_sql(chunks: str, step: int) -> str:
    return f"""
WITH s AS ({_SAMPLES}), c AS ({chunks}),
heads AS (SELECT c.*, substr(h, 2 * start + 1, {2 * K}) AS gram FROM c JOIN s USING (sample)),
grams AS (SELECT sample, substr(h, 2 * p + 1, {2 * K}) AS gram FROM (SELECT sample, h, unnest(range(0, n - {K} + 1, {step})) AS p FROM s WHERE n >= {K})),
own AS (SELECT sample, gram, count(*) AS k FROM grams GROUP BY ALL), every AS (SELECT gram, sum(k) AS k FROM own GROUP BY gram),
scored AS (SELECT h.sample, start, len, CASE WHEN len < {K} THEN 0 ELSE coalesce(e.k, 0) - coalesce(o.k, 0) END::BIGINT AS score FROM heads h LEFT JOIN every e USING (gram) LEFT JOIN own o ON o.gram = h.gram AND o.sample = h.sample),
placed AS (SELECT *, coalesce(sum(len) OVER (ORDER BY score DESC, sample, start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS "at" FROM scored)
SELECT sample, start::INTEGER AS start, len::INTEGER AS len, score, "at"::BIGINT AS "at", least(len, {SIZE} - "at")::BIGINT AS taken FROM placed WHERE "at" < {SIZE}"""


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("body"))


def _selection(df: DataFrame) -> DataFrame:
    return df.select("sample", F.col("start").cast("int").alias("start"), F.col("len").cast("int").alias("len"), "score", F.col("at").cast("bigint").alias("at"), F.col("taken").cast("bigint").alias("taken"))


@query(
    _cover_sql(
        f"SELECT sample, start, least({D}, n - start) AS len FROM (SELECT sample, n, unnest(range(0, n, {D})) AS start FROM s) WHERE least({D}, n - start) >= 8",
        1,
    )
)
def dict_train_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _selection(dictionary.cover_selection(_samples(spark, sf_dir), "item_id", "body", K, D, SIZE))


@query(_cover_sql(f"SELECT sample, start, {D} AS len FROM (SELECT sample, n, unnest(range(0, n - {D} + 1, {2 * D})) AS start FROM s WHERE n >= {D})", 5))
def dict_train_fastcover(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _selection(dictionary.fast_cover_selection(_samples(spark, sf_dir), "item_id", "body", K, D, 20, 2, SIZE))


@query(
    f'SELECT sample, n::INTEGER AS len, "at"::BIGINT AS "at", least(n, {SIZE} - "at")::BIGINT AS taken FROM (SELECT sample, n, coalesce(sum(n) OVER (ORDER BY sample ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS "at" '
    f'FROM ({_SAMPLES}) WHERE n > 0) WHERE "at" < {SIZE}'
)
def dict_train_naive(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dictionary.naive_selection(_samples(spark, sf_dir), "item_id", "body", SIZE)
    return out.select("sample", "len", F.col("at").cast("bigint").alias("at"), F.col("taken").cast("bigint").alias("taken"))


@query(_TEXT_AND_SIZE)
def dict_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts compressed with a trained dictionary of a few KiB, which travels with the options."""
    samples = _samples(spark, sf_dir)
    d = dictionary.build(samples, dictionary.cover_selection(samples, "item_id", "body", K, D, SIZE), "item_id", "body", 7)
    return _round_trip(spark, sf_dir, codec.CompressOptions(dictionary=d), codec.DecompressOptions(dictionary=d, dict_id=7, require_dictionary=True))


def _standard_dictionary(spark: SparkSession, sf_dir: str) -> bytes:
    """A dictionary with tables, made by the library from a sample of the benchmark's texts that is bounded by its bytes (naive_selection of 1 MiB)."""
    import zstandard

    samples = _samples(spark, sf_dir)
    chosen = samples.join(dictionary.naive_selection(samples, "item_id", "body", 1 << 20).select(F.col("sample").alias("item_id")), "item_id")
    return zstandard.train_dictionary(SIZE, [bytes(r.body) for r in chosen.orderBy("item_id").collect()], dict_id=1234).as_bytes()


@query("SELECT doc_id, coalesce(text, '') AS by_library, coalesce(text, '') AS by_decoder, coalesce(text, '') AS by_encoder, 1234::BIGINT AS dict_id FROM documents")
def prepared_dictionary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A standard dictionary's tables in use: frames of the library read by the library and by the decoder in Python, and frames of the encoder in Python read by the library."""
    d = _standard_dictionary(spark, sf_dir)
    back = codec.DecompressOptions(dictionary=d, standard=True)
    docs = dealt_payloads(spark, sf_dir).withColumn("a", codec.compress("payload", codec.CompressOptions(dictionary=d, standard=True))["data"])
    docs = docs.withColumn("b", codec.compress("payload", codec.CompressOptions(strategy="greedy", dictionary=d, standard=True, plain=True))["data"])
    text = lambda c, o: codec.decompress(c, o)["data"].cast("string")
    return docs.select(
        "doc_id", text("a", back).alias("by_library"), text("a", codec.replace(back, plain=True)).alias("by_decoder"), text("b", back).alias("by_encoder"), fr.dictionary_id(F.col("a")).alias("dict_id")
    )


@query("SELECT doc_id, (doc_id * 3)::BIGINT AS dict_id, hex(encode(coalesce(text, ''))) AS content FROM documents")
def dict_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = payloads(spark, sf_dir).withColumn("b", dictionary.container(F.col("payload"), F.col("doc_id") * 3))
    return docs.select("doc_id", dictionary.container_id(F.col("b")).cast("bigint").alias("dict_id"), F.hex(dictionary.container_content(F.col("b"))).alias("content"))


# Content-defined chunks


def _gear_sql(select: str) -> str:
    """Hashes by doubling: sums over 2, 4, ... 64 bytes, modulo 2**64."""
    steps, size = [], 1
    while size < 64:
        steps.append(f"g{2 * size} AS (SELECT doc_id, i, (g + coalesce(lag(g, {size}) OVER (PARTITION BY doc_id ORDER BY i), 0) * {1 << size}) % {1 << 64}::HUGEINT AS g FROM g{size})")
        size *= 2
    return f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, {_N} AS n FROM documents),
g1 AS (SELECT doc_id, i, (('0x' || substr(h, 2 * i + 1, 2))::HUGEINT + 1) * {gear.PRIME}::HUGEINT % {1 << 64}::HUGEINT AS g FROM (SELECT doc_id, h, unnest(range(n)) AS i FROM d)),
{", ".join(steps)},
ends AS (SELECT doc_id, i + 1 AS end_at FROM g64 WHERE i >= 64 AND g < {1 << 57}::HUGEINT UNION SELECT doc_id, n FROM d WHERE n > 0),
c AS (SELECT doc_id, (row_number() OVER w - 1)::INTEGER AS ord, coalesce(lag(end_at) OVER w, 0)::BIGINT AS start_at, end_at::BIGINT AS end_at FROM ends WINDOW w AS (PARTITION BY doc_id ORDER BY end_at))
{select}"""


@query(_gear_sql("SELECT * FROM c"))
def gear_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each chunk of each text."""
    return gear.splits(payloads(spark, sf_dir), "payload").select("doc_id", "ord", F.col("start").alias("start_at"), F.col("end").alias("end_at"))


@query(
    _gear_sql(
        ", b AS (SELECT c.*, substr(h, 2 * start_at + 1, 2 * (end_at - start_at)) AS body FROM c JOIN d USING (doc_id) WHERE end_at - start_at >= 64), "
        "f AS (SELECT *, first_value(doc_id) OVER w AS first_id, first_value(start_at) OVER w AS first_start FROM b WINDOW w AS (PARTITION BY body ORDER BY doc_id, start_at)) "
        "SELECT doc_id, start_at, end_at, first_id, first_start FROM f WHERE first_id <> doc_id OR first_start <> start_at"
    )
)
def gear_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long chunks that occur earlier in the corpus."""
    out = gear.repeated_chunks(gear.splits(payloads(spark, sf_dir), "payload"), "doc_id")
    return out.select("doc_id", F.col("start").alias("start_at"), F.col("end").alias("end_at"), "first_id", "first_start")


@query(f"SELECT doc_id, true AS found, true AS within, true AS same FROM documents WHERE {_N} >= 5000")
def gear_long_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text of some length twice: nearly all of the second copy lies in long matches, which reach no farther than the window and copy equal bytes."""
    docs = payloads(spark, sf_dir).where(F.octet_length("payload") >= 5000).withColumn("b", F.concat("payload", "payload"))
    found = gear.long_matches(docs, "b", 27)
    same = fb.part(F.concat("payload", "payload"), F.col("start"), F.col("length")) == fb.part(F.concat("payload", "payload"), F.col("start") - F.col("distance"), F.col("length"))
    out = found.withColumn("same", same).groupBy("doc_id").agg(
        (F.sum("length") >= 0.8 * F.first(F.octet_length("payload"))).alias("found"), F.every((F.col("distance") > 0) & (F.col("distance") <= F.col("start"))).alias("within"), F.every("same").alias("same")
    )
    return out.select("doc_id", "found", "within", "same")


# Streams


def _folder(spark: SparkSession) -> str:
    there = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    master = spark.sparkContext.master
    if there is None and not (master == "local" or master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{there or tempfile.mkdtemp()}/stream-{uuid4().hex}"


def _available(stream: DataFrame, folder: str) -> DataFrame:
    """Runs a stream over what is there, into Parquet."""
    out = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    out.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")


@query(f"SELECT doc_id, coalesce(text, '') AS text, 1::BIGINT AS n_frames, {_N} >= {_SHRINKS} AS shrunk FROM documents")
def stream_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts as streams of small chunks, every eighth of them flushed, compressed to one frame each by a stateful stream and decoded by another."""
    folder = _folder(spark)
    size = 1000
    source = table(spark, sf_dir, "documents")
    docs = spark.readStream.schema(source.schema).parquet(f"{sf_dir}/documents.parque[t]")  # a pattern may name a file or a folder
    payload = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    n = F.greatest(F.lit(1), F.ceil(F.octet_length(payload) / size)).cast("int")
    chunks = docs.select(F.col("doc_id").cast("string").alias("stream_id"), payload.alias("payload"), n.alias("n"), F.explode(F.sequence(F.lit(0), n - 1)).alias("chunk_no"))
    no = F.col("chunk_no")
    chunks = chunks.select(
        "stream_id", no.cast("bigint").alias("chunk_no"), fb.part(F.col("payload"), no * size, size).alias("chunk"), (no == F.col("n") - 1).alias("is_last"), (no % 8 == 7).alias("flush")
    )
    made = _available(compress_stream(chunks, codec.CompressOptions(strategy="greedy", checksum=True)), f"{folder}/c")
    again = spark.readStream.schema(made.schema).parquet(f"{folder}/c/out").select("stream_id", F.col("seq").alias("chunk_no"), F.col("data").alias("chunk"), F.col("done").alias("is_last"))
    back = _available(decompress_stream(again), f"{folder}/d")
    whole = codec.concat_frames(back.where("error_name IS NULL"), "stream_id", "seq", "data")
    frames = codec.concat_frames(made, "stream_id", "seq", "data").withColumnRenamed("data", "frame")
    counted = tables.frames(frames, "frame").groupBy("stream_id").agg(F.count("kind").alias("n_frames"))
    both = whole.join(counted, "stream_id").join(frames, "stream_id").withColumnRenamed("data", "payload")
    return both.select(F.col("stream_id").cast("bigint").alias("doc_id"), F.col("payload").cast("string").alias("text"), "n_frames", _shrunk())


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


__all__ = ["Column", "queries", "oracle_sql"]
