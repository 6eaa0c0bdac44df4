"""Frames of RFC 8878 as built-in expressions: detection, headers, skippable frames, blocks and a writer of raw blocks.

None of this needs a codec, and all but raw_frame is plain expressions without lambda variables, so projections and filters on headers run inside whole-stage code generation and
below any decoding step. A frame that is itself a long expression should be a column of its own first (functions.bytes.materialized).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framequarry.functions.bytes import byte_of, first_true, high_bit, in_steps, latin, number_of, part, read_le, write_le

# Fixed values of the format.
MAGIC = 0xFD2FB528
MAGIC_DICTIONARY = 0xEC30A437
MAGIC_SKIPPABLE = 0x184D2A50
SKIPPABLE_MASK = 0xFFFFFFF0
#: Version of a historic format by its first four bytes; the first is big-endian.
LEGACY = {"fd2fb51e": 1, "22b52ffd": 2, "23b52ffd": 3, "24b52ffd": 4, "25b52ffd": 5, "26b52ffd": 6, "27b52ffd": 7}
BLOCK_MAX = 1 << 17
WINDOW_LOG_MIN, WINDOW_LOG_MAX, WINDOW_LOG_DEFAULT = 10, 31, 27
#: Sentinels of content sizes, for callers that want them in place of null.
CONTENT_UNKNOWN, CONTENT_ERROR = 2**64 - 1, 2**64 - 2

HEADER_TYPE = "struct<frame_type:string,header_size:bigint,window_size:decimal(20,0),block_size_max:bigint,dict_id:bigint,checksum_flag:boolean,content_size:decimal(20,0),error_name:string>"


def magic(b: Column) -> Column:
    return read_le(b, 0, 4)


def is_skippable_magic(m: Column) -> Column:
    return F.coalesce(m.bitwiseAND(SKIPPABLE_MASK) == MAGIC_SKIPPABLE, F.lit(False))


def is_skippable_frame(b: Column) -> Column:
    return is_skippable_magic(magic(b))


def is_zstd_frame(b: Column) -> Column:
    return F.coalesce(magic(b) == MAGIC, F.lit(False))


def legacy_version(b: Column) -> Column:
    """1 to 7 for historic frames, else null."""
    head = F.lower(F.hex(part(b, 0, 4)))
    return first_true(*[(head == m, F.lit(v)) for m, v in LEGACY.items()])


def is_legacy(b: Column) -> Column:
    return legacy_version(b).isNotNull()


def detect_frame(b: Column) -> Column:
    """zstd, skippable, legacy or unknown."""
    return first_true((is_zstd_frame(b), F.lit("zstd")), (is_skippable_frame(b), F.lit("skippable")), (is_legacy(b), F.lit("legacy")), default=F.lit("unknown"))


def is_frame(b: Column) -> Column:
    return detect_frame(b) != "unknown"


#: The longest header, and one byte that tells whether more follows.
HEAD = 18


@dataclass(frozen=True)
class _Fields:
    """The parts of a header as expressions over its first bytes; those of a regular frame hold only if error is null."""

    skippable: Column
    single: Column
    size: Column
    window: Column
    dict_id: Column
    checksum: Column
    content: Column
    error: Column


def _big(c: Column) -> Column:
    return c.cast("decimal(20,0)")


def _basics(b: Column) -> dict[str, Column]:
    head = latin(part(b, 0, HEAD))
    return {"fh_head": head, "fh_n": F.octet_length(b), "fh_m": number_of(head, 0, 4), "fh_flags": byte_of(head, 4), "fh_wl": byte_of(head, 5)}


def _places(v: dict[str, Column]) -> dict[str, Column]:
    """Where the fields after the first lie."""
    flags = v["fh_flags"]
    single, code = flags.bitwiseAND(32) != 0, F.shiftright(flags, 6)
    at = F.when(single, 5).otherwise(6)
    id_size = F.element_at(F.array(*map(F.lit, (0, 1, 2, 4))), flags.bitwiseAND(3).cast("int") + 1)
    content_size = F.when((code == 0) & single, 1).otherwise(F.element_at(F.array(*map(F.lit, (0, 2, 4, 8))), code.cast("int") + 1))
    return {"fh_single": single, "fh_code": code, "fh_at": at, "fh_content_at": at + id_size, "fh_content_size": content_size, "fh_skip": v["fh_m"].bitwiseAND(SKIPPABLE_MASK) == MAGIC_SKIPPABLE}


def _values(v: dict[str, Column]) -> dict[str, Column]:
    head, at, content_at, single, code, kinds = v["fh_head"], v["fh_at"], v["fh_content_at"], v["fh_single"], v["fh_code"], v["fh_flags"].bitwiseAND(3)
    dict_id = first_true((kinds == 0, F.lit(0).cast("bigint")), (kinds == 1, byte_of(head, at)), (kinds == 2, number_of(head, at, 2)), default=number_of(head, at, 4))
    content = first_true(
        (code == 3, number_of(head, content_at, 8)), (code == 2, _big(number_of(head, content_at, 4))), (code == 1, _big(number_of(head, content_at, 2) + 256)), (single, _big(byte_of(head, content_at)))
    )
    log = F.shiftright(v["fh_wl"], 3) + WINDOW_LOG_MIN
    base = F.call_function("shiftleft", F.lit(1).cast("bigint"), log.cast("int"))
    return {"fh_id": dict_id, "fh_content": content, "fh_log": log, "fh_window": base + F.shiftright(base, 3) * v["fh_wl"].bitwiseAND(7), "fh_size": content_at + v["fh_content_size"]}


def _assembled(v: dict[str, Column]) -> _Fields:
    n, m, flags, single, skippable = v["fh_n"], v["fh_m"], v["fh_flags"], v["fh_single"], v["fh_skip"]
    error = first_true(
        (n.isNull() | (n < 4), F.lit("PrefixUnknown")),
        (skippable, F.when(n < 8, "SrcSizeWrong")),
        (m != MAGIC, F.lit("PrefixUnknown")),
        (n < 5, F.lit("SrcSizeWrong")),
        (flags.bitwiseAND(8) != 0, F.lit("FrameParameterUnsupported")),
        (~single & (n <= 5), F.lit("SrcSizeWrong")),
        (~single & (v["fh_log"] > WINDOW_LOG_MAX), F.lit("WindowTooLarge")),
        (n < v["fh_size"], F.lit("SrcSizeWrong")),
    )
    ids = F.when(skippable, m.bitwiseAND(15)).otherwise(v["fh_id"])
    contents = F.when(skippable, _big(number_of(v["fh_head"], 4, 4))).otherwise(v["fh_content"])
    windows = F.when(skippable, _big(F.lit(0))).when(single, v["fh_content"]).otherwise(_big(v["fh_window"]))
    return _Fields(skippable, single, F.when(skippable, 8).otherwise(v["fh_size"]), windows, ids, ~skippable & (flags.bitwiseAND(4) != 0), contents, error)


def _fields(b: Column) -> _Fields:
    v = _basics(b)
    v |= _places(v)
    return _assembled(v | _values(v))


def _typed(f: _Fields) -> dict[str, Column]:
    """HEADER_TYPE's fields."""
    ok = f.error.isNull()
    return {
        "frame_type": F.when(ok, F.when(f.skippable, "skippable").otherwise("regular")),
        "header_size": F.when(ok, f.size).cast("bigint"),
        "window_size": F.when(ok, f.window),
        "block_size_max": F.when(ok, F.least(f.window, _big(F.lit(BLOCK_MAX)))).cast("bigint"),
        "dict_id": F.when(ok, f.dict_id).cast("bigint"),
        "checksum_flag": F.when(ok, f.checksum),
        "content_size": F.when(ok, f.content),
        "error_name": f.error,
    }


def with_frame_header(df: DataFrame, frame_col: str, name: str = "header") -> DataFrame:
    """df with frame_header of a column, made in steps: the form for many rows, as its plan is short."""
    first = _basics(F.col(frame_col))
    v = {k: F.col(k) for k in first}
    places = _places(v)
    v |= {k: F.col(k) for k in places}
    values = _values(v)
    v |= {k: F.col(k) for k in values}
    fields = _assembled(v)
    named = {k: getattr(fields, k) for k in fields.__dataclass_fields__}
    held = _Fields(**{k: F.col(f"fh_f_{k}") for k in named})
    typed = _typed(held)
    return in_steps(df, name, first, places, values, {f"fh_f_{k}": c for k, c in named.items()}, typed)


def frame_header(b: Column) -> Column:
    """HEADER_TYPE of the frame at the start of b. Fields are null where the header can't be read; error_name says why."""
    return F.struct(*[c.alias(k) for k, c in _typed(_fields(b)).items()]).cast(HEADER_TYPE)


def frame_header_at(b: Column, offset: Column | int) -> Column:
    """frame_header of the frame at an offset of a buffer."""
    return frame_header(part(b, offset, HEAD))


def within_window(b: Column, max_window: Column | int) -> Column:
    """Whether the header at the start of b can be read and asks for no more than max_window bytes: a condition that filters can use below any decoder."""
    f = _fields(b)
    return f.error.isNull() & (f.window <= max_window)


def frame_content_size(b: Column) -> Column:
    """The declared size: 0 for skippable frames, the sentinels where it is unknown or the header is broken."""
    big = lambda x: F.lit(str(x)).cast("decimal(20,0)")
    f = _fields(b)
    return F.when(f.error.isNotNull(), big(CONTENT_ERROR)).when(f.skippable, big(0)).otherwise(F.coalesce(f.content, big(CONTENT_UNKNOWN)))


def frame_window_size(b: Column) -> Column:
    """0 where the header is broken, and for skippable frames."""
    f = _fields(b)
    return F.when(f.error.isNull(), f.window).otherwise(_big(F.lit(0)))


def dictionary_id(b: Column) -> Column:
    """0 where absent, broken or skippable."""
    f = _fields(b)
    return F.when(f.error.isNull() & ~f.skippable, f.dict_id).otherwise(F.lit(0).cast("bigint"))


def written_header_size(content_size: Column | None, dict_id: Column, single: Column) -> Column:
    """The bytes that write_frame_header gives."""
    cs = (F.lit(None) if content_size is None else content_size).cast("bigint")
    ids = first_true((dict_id == 0, F.lit(0)), (dict_id < 256, F.lit(1)), (dict_id < 65536, F.lit(2)), default=F.lit(4))
    sizes = first_true((cs.isNull(), F.lit(0)), (single & (cs < 256), F.lit(1)), ((cs >= 256) & (cs < 65792), F.lit(2)), (cs < 2**32, F.lit(4)), default=F.lit(8))
    return F.lit(5) + F.when(single, 0).otherwise(1) + ids + sizes


def write_frame_header(content_size: Column | None, window_size: Column, dict_id: Column, checksum: Column, single_segment: Column) -> Column:
    """Header bytes; the window is rounded down to a power of two (its mantissa is always 0)."""
    cs, did, single, none = (F.lit(None) if content_size is None else content_size).cast("bigint"), dict_id.cast("bigint"), single_segment, F.unhex(F.lit(""))
    did_code = first_true((did == 0, F.lit(0)), (did < 256, F.lit(1)), (did < 65536, F.lit(2)), default=F.lit(3))
    fcs_code = first_true((cs.isNull(), F.lit(0)), (single & (cs < 256), F.lit(0)), ((cs >= 256) & (cs < 65792), F.lit(1)), (cs < 2**32, F.lit(2)), default=F.lit(3))
    flags = did_code + F.when(checksum, 4).otherwise(0) + F.when(single, 32).otherwise(0) + fcs_code * 64
    log = F.greatest(F.lit(WINDOW_LOG_MIN), F.least(F.lit(WINDOW_LOG_MAX), high_bit(F.when(window_size == 0, 1 << WINDOW_LOG_DEFAULT).otherwise(window_size))))
    window = F.when(single, none).otherwise(write_le((log - WINDOW_LOG_MIN) * 8, 1))
    id_bytes = first_true((did == 0, none), (did < 256, write_le(did, 1)), (did < 65536, write_le(did, 2)), default=write_le(did, 4))
    size_bytes = first_true(
        (cs.isNull(), none), (single & (cs < 256), write_le(cs, 1)), ((cs >= 256) & (cs < 65792), write_le(cs - 256, 2)), (cs < 2**32, write_le(cs, 4)), default=write_le(cs, 8)
    )
    return F.concat(F.unhex(F.lit("28B52FFD")), write_le(flags, 1), window, id_bytes, size_bytes)


def write_skippable_frame(data: Column, variant: Column) -> Column:
    return F.concat(write_le(F.lit(MAGIC_SKIPPABLE) + variant.bitwiseAND(15), 4), write_le(F.octet_length(data), 4), data)


def skippable_frame_size(b: Column) -> Column:
    """Total bytes of the skippable frame at the start; null if it is none or cut off."""
    total = read_le(b, 4, 4) + 8
    return F.when(is_skippable_frame(b) & (total <= F.octet_length(b)), total)


def read_skippable_frame(b: Column) -> Column:
    """Its payload; null if it is none or cut off."""
    total = skippable_frame_size(b)
    return F.when(total.isNotNull(), part(b, 8, total - 8))


def block_header(b: Column, offset: Column | int = 0) -> Column:
    """struct<block_type, last, size>; null for a short buffer, block_type null for the reserved type."""
    v = read_le(b, offset, 3)
    kind = F.shiftright(v, 1).bitwiseAND(3)
    return F.when(
        v.isNotNull(),
        F.struct(first_true(*[(kind == k, F.lit(t)) for k, t in enumerate(("raw", "rle", "compressed"))]).alias("block_type"), (v.bitwiseAND(1) == 1).alias("last"), F.shiftright(v, 3).alias("size")),
    )


def write_block_header(block_type: Column, last: Column, size: Column) -> Column:
    kind = first_true((block_type == "raw", F.lit(0)), (block_type == "rle", F.lit(1)), (block_type == "compressed", F.lit(2)))
    return write_le(F.when(last, 1).otherwise(0) + kind * 2 + size.cast("bigint") * 8, 3)


def stored_block_size(b: Column, offset: Column | int = 0) -> Column:
    """Bytes of a block with its header: one byte follows for rle."""
    h = block_header(b, offset)
    return F.when(h["block_type"] == "rle", F.lit(4).cast("bigint")).otherwise(h["size"] + 3)


def compress_bound(n: Column) -> Column:
    """The most bytes that n bytes can take."""
    n = n.cast("bigint")
    return n + F.shiftright(n, 8) + F.when(n < BLOCK_MAX, F.shiftright(BLOCK_MAX - n, 11)).otherwise(0)


def raw_frame(data: Column) -> Column:
    """A frame of raw blocks of at most 128 KiB, with its content size: a valid minimal encoder without a codec. Content of one block, as most is, is only put behind its headers."""
    n = F.octet_length(data)
    blocks = F.ceil(n / F.lit(BLOCK_MAX)).cast("int")
    block = lambda i: F.concat(write_block_header(F.lit("raw"), i == blocks - 1, F.least(F.lit(BLOCK_MAX), n - i * BLOCK_MAX)), part(data, i * BLOCK_MAX, BLOCK_MAX))
    head = write_frame_header(n, F.greatest(n.cast("bigint"), F.lit(1024)), F.lit(0), F.lit(False), n < 256 * 1024)
    # binary has no array join: hex digits are joined instead
    many = F.unhex(F.array_join(F.transform(F.sequence(F.lit(0), blocks - 1), lambda i: F.hex(block(i))), ""))
    return F.concat(head, F.when(n <= BLOCK_MAX, F.concat(write_block_header(F.lit("raw"), F.lit(True), n), data)).otherwise(many))


# Versions and limits of the format and this library, as literals.
VERSION, VERSION_NUMBER = "1.0.0", 10000
FORMAT_VERSION, FORMAT_VERSION_NUMBER = "1.6.0", 10600


def supports_decode(version: Column) -> Column:
    """Whether frames of a historic version can be decoded: all seven can."""
    return F.coalesce(version.between(1, 7), F.lit(False))
