"""The library's surface by topic, and contexts that hold options from call to call.

    from framequarry.api import CompressionContext, frames
    c = CompressionContext().set_level(7).set_checksum(True)
    df.select(c.compress("payload"), frames.detect("content"))

A context is options and nothing else: each Python worker builds one codec object for them and keeps it, so it is as cheap to use in many columns as in one.
"""

from __future__ import annotations

from types import SimpleNamespace

from pyspark.sql import Column, DataFrame

from framequarry.functions import frames as _frames
from framequarry.functions import parameters as _parameters
from framequarry.operators import codec as _codec
from framequarry.operators import dictionary as _dictionary
from framequarry.operators import prepared as _prepared
from framequarry.operators import tables as _tables
from framequarry.sources import files as _files
from framequarry.streaming import chunks as _chunks


class CompressionContext:
    """Compression options that are set one by one; each setter returns the context."""

    def __init__(self, options: _codec.CompressOptions | None = None):
        self.options = options or _codec.CompressOptions()

    def _set(self, **values) -> CompressionContext:
        self.options = _codec.replace(self.options, **values)
        return self

    def set_level(self, level: int) -> CompressionContext:
        if not _parameters.LEVEL_MIN <= level <= _parameters.LEVEL_MAX:
            raise ValueError("ParameterOutOfBound")
        return self._set(level=level)

    def set_checksum(self, checksum: bool) -> CompressionContext:
        return self._set(checksum=checksum)

    def set_window_log(self, window_log: int) -> CompressionContext:
        if window_log and not _frames.WINDOW_LOG_MIN <= window_log <= _frames.WINDOW_LOG_MAX:
            raise ValueError("ParameterOutOfBound")
        return self._set(window_log=window_log)

    def set_long_distance_matching(self, ldm: bool) -> CompressionContext:
        return self._set(ldm=ldm)

    def set_pledged_size(self, size: int | None) -> CompressionContext:
        return self._set(pledged=size)

    def set_strategy(self, strategy: str | None) -> CompressionContext:
        if strategy is not None and strategy not in _parameters.STRATEGIES:
            raise ValueError("ParameterOutOfBound")
        return self._set(strategy=strategy)

    def set_workers(self, workers: int, job_size: int = 0, overlap_log: int = 0) -> CompressionContext:
        return self._set(workers=workers, job_size=job_size, overlap_log=overlap_log)

    def set_search(self, hash_log: int = 0, chain_log: int = 0, search_log: int = 0, min_match: int = 0, target_length: int = 0) -> CompressionContext:
        return self._set(hash_log=hash_log, chain_log=chain_log, search_log=search_log, min_match=min_match, target_length=target_length)

    def set_dictionary(self, dictionary: bytes | None, standard: bool = False) -> CompressionContext:
        return self._set(dictionary=dictionary, standard=standard)

    def reset(self) -> CompressionContext:
        self.options = _codec.CompressOptions()
        return self

    def compress(self, b: Column | str) -> Column:
        return _codec.compress(b, self.options)

    def compress_into(self, b: Column, room: Column) -> Column:
        return _codec.compress_into(b, room, self.options)

    def compress_stream(self, df: DataFrame, idle_ms: int | None = None) -> DataFrame:
        return _chunks.compress_stream(df, self.options, idle_ms)


class DecompressionContext:
    """Decompression options that are set one by one; each setter returns the context."""

    def __init__(self, options: _codec.DecompressOptions | None = None):
        self.options = options or _codec.DecompressOptions()

    def _set(self, **values) -> DecompressionContext:
        self.options = _codec.replace(self.options, **values)
        return self

    def set_max_window_size(self, size: int) -> DecompressionContext:
        return self._set(max_window=size)

    def set_max_output(self, size: int | None) -> DecompressionContext:
        return self._set(max_output=size)

    def set_ignore_checksum(self, ignore: bool) -> DecompressionContext:
        return self._set(ignore_checksum=ignore)

    def set_dictionary(self, dictionary: bytes | None, dict_id: int = 0, standard: bool = False, required: bool = False) -> DecompressionContext:
        return self._set(dictionary=dictionary, dict_id=dict_id, standard=standard, require_dictionary=required)

    def reset(self) -> DecompressionContext:
        self.options = _codec.DecompressOptions()
        return self

    def decompress(self, b: Column | str) -> Column:
        return _codec.decompress(b, self.options)

    def decompress_into(self, b: Column | str, room: Column) -> Column:
        return _codec.decompress_into(b, room, self.options)

    def decompress_frame(self, b: Column | str) -> Column:
        return _codec.decompress_frame(b, self.options)

    def decompress_stream(self, df: DataFrame, idle_ms: int | None = None) -> DataFrame:
        return _chunks.decompress_stream(df, self.options, idle_ms)


compression = SimpleNamespace(
    compress=_codec.compress, compress_into=_codec.compress_into, compress_one_frame=_codec.compress_one_frame, compress_jobs=_codec.compress_jobs, bound=_frames.compress_bound, context=CompressionContext
)
decompression = SimpleNamespace(
    decompress=_codec.decompress, decompress_into=_codec.decompress_into, decompress_frame=_codec.decompress_frame, bound=_tables.decompress_bound, context=DecompressionContext
)
streaming = SimpleNamespace(compress=_chunks.compress_stream, decompress=_chunks.decompress_stream)
dictionaries = SimpleNamespace(
    container=_dictionary.container, content=_dictionary.container_content, id=_dictionary.container_id, cover=_dictionary.cover_selection, fast_cover=_dictionary.fast_cover_selection,
    naive=_dictionary.naive_selection, build=_dictionary.build, prepare=_prepared.prepare, from_content=_prepared.from_content,
)
frames = SimpleNamespace(
    detect=_frames.detect_frame, is_frame=_frames.is_frame, header=_frames.frame_header, header_at=_frames.frame_header_at, content_size=_frames.frame_content_size, window_size=_frames.frame_window_size,
    dictionary_id=_frames.dictionary_id, within_window=_frames.within_window, scan=_tables.frames, blocks=_tables.blocks, inspect=_tables.inspect_frames, raw=_frames.raw_frame,
)
legacy = SimpleNamespace(version=_frames.legacy_version, is_legacy=_frames.is_legacy, supports_decode=_frames.supports_decode, write=_codec.compress_historic)
io = SimpleNamespace(read=_files.read_buffers, read_decompressed=_files.read_decompressed, read_lines=_files.read_lines, compressed=_files.compressed, write_parquet=_files.write_parquet)
