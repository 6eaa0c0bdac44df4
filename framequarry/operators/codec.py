"""Compression and decompression of binary columns. Errors are data: a broken row has a null result and an error name, and never fails its task.

Each Python worker keeps one codec object per set of options. Rows are worked on in Arrow batches; nothing is shuffled. A column made by the header functions is given to
these by functions.bytes.materialized.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framequarry.functions.frames import CONTENT_ERROR, WINDOW_LOG_DEFAULT, compress_bound, frame_header, within_window
from framequarry.functions.parameters import JOB_MIN, STRATEGIES, STRATEGY_BOUNDS, with_frame_plan, with_job_split
from framequarry.operators.decoder import decode_regular
from framequarry.operators.encoder import BlockState, encode_blocks, encode_frame, frame_head
from framequarry.operators.historic import decode_legacy
from framequarry.operators.historic_writer import VERSIONS as HISTORIC_WRITTEN
from framequarry.operators.historic_writer import encode_historic
from framequarry.operators.prepared import Prepared, prepare
from framequarry.operators.walk import FrameError, frame_end, legacy_of, read_blocks, read_header

RESULT = "struct<data:binary,error_name:string>"
#: Names and texts of errors.
ERROR_TEXTS = {
    "Corruption": "corruption_detected",
    "ChecksumWrong": "checksum_wrong",
    "DictionaryCorrupted": "dictionary_corrupted",
    "DictionaryWrong": "dictionary_wrong",
    "ParameterOutOfBound": "parameter_outOfBound",
    "TableLogTooLarge": "tableLog_tooLarge",
    "MaxSymbolValueTooLarge": "maxSymbolValue_tooLarge",
    "MaxSymbolValueTooSmall": "maxSymbolValue_tooSmall",
    "StageWrong": "stage_wrong",
    "InitMissing": "init_missing",
    "MemoryAllocation": "memory_allocation",
    "WorkspaceTooSmall": "workSpace_tooSmall",
    "DstSizeTooSmall": "dstSize_tooSmall",
    "SrcSizeWrong": "srcSize_wrong",
    "SrcSizeTooLarge": "srcSize_tooLarge",
    "DstBufferNull": "dstBuffer_null",
    "NoForwardProgressDestFull": "noForwardProgress_destFull",
    "NoForwardProgressInputEmpty": "noForwardProgress_inputEmpty",
    "FrameIndexTooLarge": "frameIndex_tooLarge",
    "PrefixUnknown": "prefix_unknown",
    "VersionUnsupported": "version_unsupported",
    "FrameParameterUnsupported": "frameParameter_unsupported",
    "WindowTooLarge": "windowTooLarge",
    "UnsupportedFeature": "unsupported_feature",
    "InvalidMagic": "invalid_magic",
    "InvalidFrameHeader": "invalid_frame_header",
    "InvalidBlock": "invalid_block",
    "InvalidBlockSize": "invalid_block_size",
    "InvalidDictionary": "invalid_dictionary",
    "InvalidFseTable": "invalid_fse_table",
    "InvalidHuffmanTable": "invalid_huffman_table",
    "InvalidSequence": "invalid_sequence",
    "InvalidOffset": "invalid_offset",
    "OffsetTooLarge": "offset_too_large",
    "ContentSizeMismatch": "content_size_mismatch",
    "AllocationFailure": "allocation_failure",
    "GenericError": "generic_error",
    "OutOfMemory": "out_of_memory",
}


@dataclass(frozen=True)
class CompressOptions:
    """level 0: the default. strategy and settings left at None or 0 come from the level. dictionary: raw content or a container; with `standard` its tables are used too.

    pledged: the content's size; another one is SrcSizeWrong. workers: threads of one task that make one frame of a large buffer, with jobs of job_size and overlaps by overlap_log.
    plain: encode in Python instead of by the library.
    """

    level: int = 3
    strategy: str | None = None
    checksum: bool = False
    window_log: int = 0
    ldm: bool = False
    content_size: bool = True
    dictionary: bytes | None = None
    standard: bool = False
    hash_log: int = 0
    chain_log: int = 0
    search_log: int = 0
    min_match: int = 0
    target_length: int = 0
    workers: int = 0
    job_size: int = 0
    overlap_log: int = 0
    pledged: int | None = None
    plain: bool = False


@dataclass(frozen=True)
class DecompressOptions:
    """plain: decode in Python instead of by the library, which is far slower. max_output: the most bytes that a buffer may give; beyond it decoding stops with DstSizeTooSmall."""

    max_window: int = 1 << 27
    ignore_checksum: bool = False
    dictionary: bytes | None = None
    dict_id: int = 0
    require_dictionary: bool = False
    standard: bool = False
    max_output: int | None = None
    plain: bool = False


_CODECS: dict = {}


def _dictionary(content: bytes, standard: bool = False):
    """A standard dictionary with its tables; else its content: a container's header of 8 bytes is no part of it."""
    import zstandard

    if standard:
        return zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_FULLDICT)
    return zstandard.ZstdCompressionDict(_content(content), dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def _content(dictionary: bytes) -> bytes:
    return dictionary[8:] if dictionary[:4] == b"\x37\xa4\x30\xec" else dictionary


def _prepared(dictionary: bytes) -> Prepared:
    if ("p", dictionary) not in _CODECS:
        _CODECS["p", dictionary] = prepare(dictionary)
    return _CODECS["p", dictionary]


def compressor(o: CompressOptions):
    """The worker's codec object for these options."""
    import zstandard

    if o not in _CODECS:
        more = {"write_checksum": o.checksum, "write_content_size": o.content_size, "enable_ldm": o.ldm, "threads": o.workers, "write_dict_id": o.standard}
        more |= {k: v for k in ("window_log", "hash_log", "chain_log", "search_log", "min_match", "target_length", "job_size", "overlap_log") if (v := getattr(o, k))}
        if o.strategy:
            more["strategy"] = STRATEGIES.index(o.strategy) + 1
        params = zstandard.ZstdCompressionParameters.from_level(o.level or 3, **more)
        _CODECS[o] = zstandard.ZstdCompressor(compression_params=params, dict_data=_dictionary(o.dictionary, o.standard) if o.dictionary else None)
    return _CODECS[o]


def encode(data: bytes, o: CompressOptions) -> bytes:
    """One buffer as one frame."""
    import zstandard

    if o.pledged is not None and o.pledged != len(data):
        raise FrameError("SrcSizeWrong")
    if not o.plain:
        try:
            return compressor(o).compress(data)
        except (zstandard.ZstdError, ValueError) as e:
            raise FrameError("ParameterOutOfBound") from e
    strategy = o.strategy or plain_strategy(o.level)
    if o.dictionary and o.standard:
        d = _prepared(o.dictionary)
        return encode_frame(data, strategy, o.checksum, o.window_log, o.content_size, d.content, d.dict_id, d.for_encoding())
    return encode_frame(data, strategy, o.checksum, o.window_log, o.content_size, _content(o.dictionary or b""))


def plain_strategy(level: int) -> str:
    """The plain encoder's strategy for a level."""
    return next((s for top, s in zip(STRATEGY_BOUNDS, STRATEGIES, strict=False) if (level or 3) <= top), STRATEGIES[-1])


def _decompressor(dictionary: bytes | None, standard: bool = False):
    import zstandard

    if ("d", dictionary, standard) not in _CODECS:
        _CODECS["d", dictionary, standard] = zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary, standard) if dictionary else None, max_window_size=1 << 31)
    return _CODECS["d", dictionary, standard]


def _without_checksum(frame: bytes) -> bytes:
    h = read_header(frame)
    return frame[:4] + bytes([frame[4] & ~4]) + frame[5:-4] if h.checksum else frame


def decode_frame(frame: bytes, o: DecompressOptions, room: int | None = None) -> bytes:
    """One whole regular frame. room: the most bytes it may give; no more than that is ever held."""
    import zstandard

    h = read_header(frame)
    if h.window > o.max_window:
        raise FrameError("WindowTooLarge")
    known = o.dict_id or (_prepared(o.dictionary).dict_id if o.standard and o.dictionary else 0)
    if h.dict_id and o.dictionary and h.dict_id != known:
        raise FrameError("DictionaryWrong")
    if room is not None and h.content is not None and h.content > room:
        raise FrameError("DstSizeTooSmall")
    if o.plain:
        frame = _without_checksum(frame) if o.ignore_checksum else frame
        if o.dictionary and o.standard:
            return decode_regular(frame, _prepared(o.dictionary).content, room, _prepared(o.dictionary).for_decoding())
        return decode_regular(frame, _content(o.dictionary or b""), room)
    body = _without_checksum(frame)
    if h.dict_id and not o.standard:  # raw content has no id to compare with
        at = 5 + (0 if frame[4] & 32 else 1)
        n = (0, 1, 2, 4)[frame[4] & 3]
        body = body[:4] + bytes([body[4] & ~3]) + body[5:at] + body[at + n :]
    try:
        decoder = _decompressor(o.dictionary, o.standard)
        if room is None:
            out = decoder.decompressobj().decompress(body)
        else:
            out = decoder.stream_reader(body).read(room + 1)
    except zstandard.ZstdError as e:
        raise FrameError(_exact_error(frame, o, _error_of(str(e)))) from e
    except MemoryError as e:
        raise FrameError("OutOfMemory") from e
    if room is not None and len(out) > room:
        raise FrameError("DstSizeTooSmall")
    if h.content is not None and len(out) != h.content:
        raise FrameError("ContentSizeMismatch")
    if h.checksum and not o.ignore_checksum and xxhash.xxh64_intdigest(out) & 0xFFFFFFFF != int.from_bytes(frame[-4:], "little"):
        raise FrameError("ChecksumWrong")
    return out


def _exact_error(frame: bytes, o: DecompressOptions, name: str) -> str:
    """What the decoder in Python makes of a frame that the library calls corrupt, as the library has one name for most errors."""
    if name != "Corruption":
        return name
    try:
        decode_frame(frame, replace(o, plain=True), read_header(frame).content)
    except FrameError as e:
        return "ContentSizeMismatch" if str(e) == "DstSizeTooSmall" else str(e)
    return name


def _error_of(message: str) -> str:
    m = message.lower()
    if "dictionary mismatch" in m:
        return "DictionaryWrong"
    if "dictionary" in m:
        return "DictionaryCorrupted"
    if "too much memory" in m or "window" in m:
        return "WindowTooLarge"
    if "src size" in m:
        return "SrcSizeWrong"
    if "checksum" in m:
        return "ChecksumWrong"
    return "Corruption"


def decode_all(b: bytes, o: DecompressOptions, room: int | None = None) -> bytes:
    """All frames of a buffer, one after the other; skippable ones give nothing. An empty buffer is empty. room: the most bytes that all may give (default: max_output)."""
    if o.require_dictionary and not o.dictionary and b:
        raise FrameError("DictionaryWrong")
    room = o.max_output if room is None else room
    out, at = [], 0
    while at < len(b):
        if at + 4 > len(b):
            raise FrameError("SrcSizeWrong")
        left = None if room is None else room - sum(map(len, out))
        if legacy_of(b, at):
            data, at = decode_legacy(b, at, left)
            out.append(data)
            continue
        h, end = frame_end(b, at)
        if h.kind == "regular":
            out.append(decode_frame(b[at:end], o, left))
        at = end
    return b"".join(out)


def _tried(f, b: bytes | None) -> tuple[bytes | None, str | None]:
    if b is None:
        return None, None
    try:
        return f(bytes(b)), None
    except FrameError as e:
        return None, str(e)


#: Tasks for each core where rows are dealt out.
TASKS = 4
#: Values that leave a worker together: at most this many, and no more once they have this many bytes.
VALUES, VALUE_BYTES = 256, 4 << 20
_RESULT_TYPES = (("data", pa.binary()), ("error_name", pa.string()))
_CONSUMED_TYPES = (("data", pa.binary()), ("consumed", pa.int64()), ("error_name", pa.string()))


def _by_value(rows: Iterator[tuple], types: tuple) -> Iterator[pa.Array]:
    """Structs of the rows, in pieces: however large a batch is, few of its values are Python objects at once."""
    held, size = [], 0

    def made() -> pa.Array:
        return pa.StructArray.from_arrays([pa.array([r[i] for r in held], t) for i, (_, t) in enumerate(types)], names=[n for n, _ in types])  # noqa: B023

    for row in rows:
        held.append(row)
        size += len(row[0] or b"")
        if len(held) == VALUES or size >= VALUE_BYTES:
            yield made()
            held, size = [], 0
    if held:
        yield made()


def _each(f) -> Callable:
    """RESULT of f for each value of a column."""

    @F.arrow_udf(RESULT)
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for a in parts:
            yield from _by_value((_tried(f, x.as_py()) for x in a), _RESULT_TYPES)

    return run


def compress(b: Column | str, options: CompressOptions | None = None) -> Column:
    """RESULT of compressing a binary column; null stays null."""
    o = options or CompressOptions()
    return _each(lambda x: encode(x, o))(b)


def compress_historic(b: Column | str, version: int) -> Column:
    """RESULT of writing a binary column as frames of a historic version, 0.2 to 0.5."""
    return _each(lambda x: encode_historic(x, version))(b)


def decompress(b: Column | str, options: DecompressOptions | None = None) -> Column:
    """RESULT of decoding all frames of a binary column."""
    o = options or DecompressOptions()
    return _each(lambda x: decode_all(x, o))(b)


def decompress_frame(b: Column | str, options: DecompressOptions | None = None) -> Column:
    """Exactly the first frame: struct<data, consumed, error_name>. A skippable one gives empty data."""
    o = options or DecompressOptions()

    def one(x: bytes | None) -> tuple:
        if x is None:
            return None, None, None
        try:
            h, end = frame_end(x)
            return (b"" if h.kind == "skippable" else decode_frame(x[:end], o)), end, None
        except FrameError as e:
            return None, None, str(e)

    @F.arrow_udf("struct<data:binary,consumed:long,error_name:string>")
    def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for a in parts:
            yield from _by_value((one(x.as_py()) for x in a), _CONSUMED_TYPES)

    return run(b)


def compress_into(b: Column, room: Column, options: CompressOptions | None = None) -> Column:
    """Compression into a buffer of `room` bytes, which must hold the bound even if the frame would be smaller."""
    fits = room >= compress_bound(F.octet_length(b))
    none = F.struct(F.lit(None).cast("binary").alias("data"), F.lit("DstSizeTooSmall").alias("error_name"))
    return F.when(fits, compress(F.when(fits, b), options)).otherwise(none)


def decompress_into(b: Column | str, room: Column, options: DecompressOptions | None = None) -> Column:
    """Decoding into a buffer of `room` bytes: the decoder stops there, however much the frames would give."""
    o = options or DecompressOptions()

    @F.arrow_udf(RESULT)
    def run(parts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for s, most in parts:
            yield from _by_value((_tried(lambda y: decode_all(y, o, n.as_py()), x.as_py()) for x, n in zip(s, most, strict=True)), _RESULT_TYPES)  # noqa: B023

    return run(b, F.greatest(F.coalesce(room.cast("long"), F.lit(0)), F.lit(0)))


def checksum(b: Column | str) -> Column:
    """The low 32 bits of XXH64 with seed 0, as a frame's end has it."""

    @F.pandas_udf("long")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else xxhash.xxh64_intdigest(bytes(x)) & 0xFFFFFFFF).astype("Int64")

    return run(b)


def dealt(df: DataFrame, *columns: str) -> DataFrame:
    """df dealt out by columns over tasks for all cores, some for each. A file of few row groups is read by few tasks, too few for what takes a second or more for each MB."""
    return df.repartition(TASKS * max(2, df.sparkSession.sparkContext.defaultParallelism), *columns)


def compress_jobs(df: DataFrame, id_col: str, payload_col: str, job_size: int, options: CompressOptions | None = None) -> DataFrame:
    """One buffer as independent frames of job_size bytes each, made in parallel and put together in order: id_col, frame.

    A decoder reads the frames one after the other, so the result decodes as one frame would.
    """
    n = F.octet_length(payload_col)
    jobs = F.greatest(F.lit(1), F.ceil(n / F.lit(job_size))).cast("int")
    parts = df.select(id_col, payload_col, F.explode(F.sequence(F.lit(0), jobs - 1)).alias("job"))
    parts = parts.select(id_col, "job", F.substring(payload_col, F.col("job") * job_size + 1, F.lit(job_size)).alias("part"))
    made = parts.select(id_col, "job", compress("part", options)["data"].alias("frame"))
    return concat_frames(made, id_col, "job", "frame")


def compress_one_frame(df: DataFrame, id_col: str, payload_col: str, threads: int, options: CompressOptions | None = None, job_min: int = JOB_MIN) -> DataFrame:
    """One buffer as one frame whose blocks are made by parallel jobs: id_col, frame, num_jobs.

    Jobs, their size and overlap are those of `with_job_split`. Each job's row carries its own part and the overlap before it, from which its matches may be copied; as it doesn't
    know the repeats and codes of the blocks before, it uses none. The blocks are put after each other behind one header, and the checksum of all, if wanted, after them.
    """
    o = options or CompressOptions()
    strategy = o.strategy or plain_strategy(o.level)
    whole = df.select(id_col, F.col(payload_col).alias("payload_"), F.octet_length(payload_col).cast("long").alias("n_"))
    planned = with_frame_plan(whole, F.col("n_"), F.lit(o.window_log), F.lit(o.ldm), F.lit(0), "plan_")
    split = with_job_split(planned, F.col("n_"), F.lit(threads), F.lit(strategy), "plan_", F.lit(o.ldm), "split_", job_min)
    jobs = split.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("split_.num_jobs") - 1)).alias("job_"))
    at = F.col("job_") * F.col("split_.job_size")
    before = F.least(at, F.col("split_.overlap"))
    parts = jobs.select(
        id_col,
        "job_",
        F.col("split_.num_jobs").alias("num_jobs"),
        F.substring("payload_", (at - before + 1).cast("int"), (before + F.col("split_.job_size")).cast("int")).alias("part_"),
        before.alias("before_"),
        F.col("plan_.window_size").alias("window_"),
        F.when(F.col("job_") == 0, F.col("n_")).alias("n_"),
        F.when((F.col("job_") == F.col("split_.num_jobs") - 1) & F.lit(o.checksum), F.col("payload_")).alias("all_"),
    )

    @F.arrow_udf("binary")
    def run(rows: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for columns in rows:
            for i in range(0, len(columns[0]), VALUES):
                yield pa.array([_job(*(x.as_py() for x in row), strategy, o) for row in zip(*(c.slice(i, VALUES) for c in columns), strict=True)], pa.binary())

    made = dealt(parts, id_col, "job_").select(id_col, "job_", "num_jobs", run("job_", "num_jobs", "part_", "before_", "window_", "n_", "all_").alias("frame"))
    packed = F.sort_array(F.collect_list(F.struct("job_", F.hex("frame").alias("x"))))
    return made.groupBy(id_col, "num_jobs").agg(F.unhex(F.array_join(F.transform(packed, lambda s: s["x"]), "")).alias("frame"))


def _job(job, jobs, part, before, window, n, all_, strategy: str, o: CompressOptions) -> bytes:
    """A job's blocks; the header before the first ones, the checksum of all bytes after the last."""
    log = max(10, min(WINDOW_LOG_DEFAULT, (window - 1).bit_length()))
    state = BlockState() if not job else BlockState([None] * 3)
    blocks = encode_blocks(part[before:], part[:before], job == jobs - 1, state, 1 << log, strategy)
    head = frame_head(n if o.content_size else None, log, o.checksum) if not job else b""
    end = (xxhash.xxh64_intdigest(all_) & 0xFFFFFFFF).to_bytes(4, "little") if all_ is not None else b""
    return head + blocks + end


def concat_frames(df: DataFrame, id_col: str, order_col: str, frame_col: str) -> DataFrame:
    """One buffer per id from its frames in order."""
    packed = F.sort_array(F.collect_list(F.struct(order_col, F.hex(frame_col).alias("x"))))
    return df.groupBy(id_col).agg(F.unhex(F.array_join(F.transform(packed, lambda s: s["x"]), "")).alias(frame_col))


def guarded(df: DataFrame, frame_col: str, max_window: int) -> DataFrame:
    """Rows whose header allows decoding within a window, by a native filter that runs below any decoder."""
    return df.where(within_window(F.col(frame_col), max_window))


def content_length(b: Column, decoded: Column) -> Column:
    """The decoded length: from the header where it is declared, without decoding; else from the decoded bytes."""
    h = frame_header(b)
    return F.coalesce(h["content_size"].cast("bigint"), F.octet_length(decoded).cast("bigint"))


def error_text(name: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for p in ERROR_TEXTS.items() for x in p]), name)


def register(spark: SparkSession) -> None:
    """SQL functions fq_compress(binary), fq_decompress(binary), fq_checksum(binary)."""

    @F.pandas_udf("binary")
    def fq_compress(s: pd.Series) -> pd.Series:
        c = compressor(CompressOptions())
        return s.map(lambda x: None if x is None else c.compress(bytes(x)))

    @F.pandas_udf("binary")
    def fq_decompress(s: pd.Series) -> pd.Series:
        return s.map(lambda x: _tried(lambda y: decode_all(y, DecompressOptions()), x)[0])

    @F.pandas_udf("long")
    def fq_checksum(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else xxhash.xxh64_intdigest(bytes(x)) & 0xFFFFFFFF)

    for f in (fq_compress, fq_decompress, fq_checksum):
        spark.udf.register(f.__name__, f)


__all__ = ["CONTENT_ERROR", "CompressOptions", "DecompressOptions", "compress", "decompress", "read_blocks", "replace"]
