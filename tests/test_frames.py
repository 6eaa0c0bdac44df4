"""Frames, codecs and table functions: round trips, known frames, malformed ones, limits."""

from __future__ import annotations

import random

import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from framequarry.functions import bytes as fb
from framequarry.functions import frames as fr
from framequarry.operators import codec, offsets, tables, walk
from framequarry.plans.golden import GOLDEN, LEGACY_FRAMES

SIZES = (0, 1, 3, 7, 16, 63, 255, 256, 1024, 4096, 65536, 131073)


def corpora(n: int) -> dict[str, bytes]:
    rng = random.Random(n)
    lcg, out = 0x12345678, bytearray()
    for _ in range(n):
        lcg = (lcg * 6364136223846793005 + 1442695040888963407) % 2**64
        out.append((lcg >> 33) % 4)
    return {
        "zeros": bytes(n),
        "ones": b"\xff" * n,
        "alternating": (b"\xaa\x55" * n)[:n],
        "incrementing": bytes(i % 256 for i in range(n)),
        "repeating": (b"abcabcabdabcabcabeabcabcabf" * (n // 27 + 1))[:n],
        "random": rng.randbytes(n),
        "lcg": bytes(out),
    }


def frame_df(spark, rows):
    return spark.createDataFrame([(k, bytearray(b) if b is not None else None) for k, b in rows], "name string, b binary")


@pytest.mark.parametrize("o", [codec.CompressOptions(level=n) for n in (1, 3, 7, 19)] + [codec.CompressOptions(checksum=True), codec.CompressOptions(strategy="btopt", window_log=12), codec.CompressOptions(ldm=True, content_size=False)])
def test_round_trip_matrix(spark, o):
    rows = [(f"{name}-{n}", data) for n in SIZES for name, data in corpora(n).items()] + [("null", None)]
    assert len(rows) == len(SIZES) * 7 + 1
    df = frame_df(spark, rows).withColumn("frame", codec.compress("b", o)["data"]).withColumn("r", codec.decompress("frame"))
    assert df.where(~F.col("r.data").eqNullSafe(F.col("b")) | F.col("r.error_name").isNotNull()).count() == 0
    assert df.where(F.octet_length("frame") > fr.compress_bound(F.octet_length("b")) + 32).count() == 0


def test_any_codec_reads_raw_frames(spark):
    rows = [(str(n), random.Random(n).randbytes(n)) for n in (*SIZES, 262143, 262144, 300000)]
    for r in frame_df(spark, rows).select("b", fr.raw_frame(F.col("b")).alias("frame")).collect():
        assert zstandard.ZstdDecompressor().decompressobj().decompress(bytes(r.frame)) == bytes(r.b)
        assert zstandard.frame_content_size(bytes(r.frame)) == len(r.b)


def test_known_frames(spark):
    rows = frame_df(spark, [(n, bytes.fromhex(h)) for n, h, _ in GOLDEN])
    got = {r.name: r for r in rows.select("name", codec.decompress("b").alias("r")).collect()}
    for name, _, want in GOLDEN:
        r = got[name].r
        assert (r.data is None) == (want is None) and (want is None or len(r.data) == want), name
        assert (r.error_name is None) == (want is not None)


def test_empty_input_is_empty(spark):
    r = frame_df(spark, [("e", b"")]).select(codec.decompress("b").alias("r")).first().r
    assert bytes(r.data) == b"" and r.error_name is None


def header_of(spark, frames):
    df = spark.createDataFrame([(i, bytearray(f)) for i, f in enumerate(frames)], "i int, b binary")
    return [r.h for r in df.select("i", fr.frame_header(F.col("b")).alias("h")).orderBy("i").collect()]


def test_headers_agree_with_the_walker(spark):
    rng = random.Random(3)
    frames = [bytes.fromhex(h) for _, h, _ in GOLDEN] + [zstandard.ZstdCompressor(level=5).compress(rng.randbytes(n)) for n in (0, 200, 300, 70000, 300000)]
    frames += [f[:k] for f in frames[:4] for k in range(8)] + [b"\x28\xb5\x2f\xfd" + rng.randbytes(14) for _ in range(200)] + [b"\x50\x2a\x4d\x18\x05\0\0\0hello", b"\x5f\x2a\x4d\x18\x05\0", b""]
    for f, h in zip(frames, header_of(spark, frames), strict=True):
        try:
            want = walk.read_header(f)
        except walk.FrameError as e:
            assert h.error_name == str(e), f.hex()
            continue
        assert h.error_name is None, f.hex()
        assert (h.frame_type, h.header_size, int(h.window_size), h.dict_id, h.checksum_flag) == (want.kind, want.size, want.window, want.dict_id, want.checksum)
        assert (None if h.content_size is None else int(h.content_size)) == want.content


def test_large_numbers(spark):
    b = bytes.fromhex("28b52ffde0") + b"\xff" * 8
    (h,) = header_of(spark, [b])
    assert int(h.content_size) == 2**64 - 1 and int(h.window_size) == 2**64 - 1 and h.block_size_max == 131072
    df = frame_df(spark, [("x", b), ("y", b"nothing")])
    got = {r.name: r.n for r in df.select("name", fr.frame_content_size(F.col("b")).alias("n")).collect()}
    assert int(got["y"]) == fr.CONTENT_ERROR


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.binary(max_size=300), st.integers(0, 2)), max_size=6), st.integers(0, 3))
def test_walk_covers_the_buffer(parts, cut):
    b, want = b"", b""
    for data, kind in parts:
        if kind == 2:
            b += (0x184D2A50 + len(data) % 16).to_bytes(4, "little") + len(data).to_bytes(4, "little") + data
        else:
            b += zstandard.ZstdCompressor(write_checksum=bool(kind)).compress(data)
            want += data
    assert codec.decode_all(b, codec.DecompressOptions()) == want
    assert sum(r[3] for r in tables.frame_rows(b)) == len(b)
    if b and cut:
        rows = list(tables.frame_rows(b[:-cut]))
        assert rows[-1][-1] in ("SrcSizeWrong", "PrefixUnknown", "InvalidMagic") or sum(r[3] for r in rows) == len(b) - cut


def test_errors_are_rows(spark):
    good = zstandard.ZstdCompressor(write_checksum=True).compress(b"hello world " * 50)
    wrong = good[:-1] + bytes([good[-1] ^ 1])
    rows = [("good", good), ("cut", good[:-3]), ("sum", wrong), ("junk", b"abcdefgh"), ("short", b"ab"), ("legacy", bytes.fromhex(LEGACY_FRAMES[3])), ("old cut", bytes.fromhex(LEGACY_FRAMES[1])[:-1]), ("null", None), ("tail", good + b"xyz")]
    got = {r.name: r.r for r in frame_df(spark, rows).select("name", codec.decompress("b").alias("r")).collect()}
    names = {k: r.error_name for k, r in got.items()}
    assert names == {"good": None, "cut": "SrcSizeWrong", "sum": "ChecksumWrong", "junk": "PrefixUnknown", "short": "SrcSizeWrong", "legacy": None, "old cut": "SrcSizeWrong", "null": None, "tail": "SrcSizeWrong"}
    ignoring = frame_df(spark, rows).where("name = 'sum'").select(codec.decompress("b", codec.DecompressOptions(ignore_checksum=True)).alias("r")).first().r
    assert bytes(ignoring.data) == b"hello world " * 50


@pytest.mark.parametrize(("log", "limit", "ok"), [(20, 1 << 20, True), (20, (1 << 20) - 1, False), (10, 1 << 10, True), (27, 1 << 27, True), (27, 1 << 26, False)])
def test_window_limits(spark, log, limit, ok):
    p = zstandard.ZstdCompressionParameters(window_log=log, write_content_size=False)
    c = zstandard.ZstdCompressor(compression_params=p).compressobj()
    frame = c.compress(b"x" * 5000) + c.flush()
    df = frame_df(spark, [("w", frame)])
    r = df.select(codec.decompress("b", codec.DecompressOptions(max_window=limit)).alias("r")).first().r
    assert (r.error_name is None) == ok and (ok or r.error_name == "WindowTooLarge")
    assert codec.guarded(df, "b", limit).count() == int(ok)


def test_header_filter_runs_below_the_decoder(spark):
    df = frame_df(spark, [("w", zstandard.compress(b"abc"))])
    out = codec.guarded(df.select("name", "b"), "b", 1024).withColumn("r", codec.decompress("b")).where("name <> 'none'")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.index("ArrowEvalPython") < plan.index("Filter")


def test_dictionaries(spark):
    d = b"common words of many samples and others " * 20
    rows = frame_df(spark, [("a", b"common words of many samples")])
    made = rows.withColumn("frame", codec.compress("b", codec.CompressOptions(dictionary=d))["data"])
    assert bytes(made.select(codec.decompress("frame", codec.DecompressOptions(dictionary=d))["data"].alias("x")).first().x) == b"common words of many samples"
    none = made.select(codec.decompress("frame", codec.DecompressOptions(require_dictionary=True))["error_name"].alias("x")).first().x
    assert none == "DictionaryWrong"
    plain = rows.select(F.octet_length(codec.compress("b")["data"]).alias("n")).first().n
    assert made.select(F.octet_length("frame").alias("n")).first().n < plain


def test_skippable_frames_of_all_variants(spark):
    df = spark.range(16).select("id", fr.write_skippable_frame(F.encode(F.lit("payload"), "UTF-8"), F.col("id")).alias("b"))
    for r in df.select("id", fr.frame_header(F.col("b"))["dict_id"].alias("v"), fr.read_skippable_frame(F.col("b")).alias("p"), fr.detect_frame(F.col("b")).alias("k"), fr.read_skippable_frame(F.substring("b", 1, 10)).alias("cut")).collect():
        assert (r.v, bytes(r.p), r.k, r.cut) == (r.id, b"payload", "skippable", None)


def test_bits(spark):
    xs = [1, 2, 3, 8, 255, 256, 2**31, 2**32 - 1, 2**40 + 4]
    df = spark.createDataFrame([(x,) for x in xs], "x long")
    cols = (fb.high_bit(F.col("x")), fb.trailing_zeros(F.col("x")), fb.rotate_left32(F.col("x"), 7), fb.rotate_right64(F.col("x"), 9), fb.read_le(fb.write_le(F.col("x"), 8), 0, 8))
    for r in df.select("x", *[c.alias(f"c{i}") for i, c in enumerate(cols)]).collect():
        x, low = r.x, r.x & 0xFFFFFFFF
        right = (x >> 9 | x << 55) & (2**64 - 1)
        assert (r.c0, r.c1, r.c2, r.c3 % 2**64, int(r.c4)) == (x.bit_length() - 1, (x & -x).bit_length() - 1, (low << 7 | low >> 25) & 0xFFFFFFFF, right, x)


def test_block_headers(spark):
    df = spark.createDataFrame([("raw", True, 5), ("rle", False, 131072), ("compressed", True, 77)], "t string, last boolean, n long")
    for r in df.select("*", fr.block_header(fr.write_block_header(F.col("t"), F.col("last"), F.col("n"))).alias("h")).collect():
        assert (r.h.block_type, r.h.last, r.h.size) == (r.t, r.last, r.n)


def test_sql_functions(spark):
    codec.register(spark)
    tables.register(spark)
    r = spark.sql("SELECT cast(fq_decompress(fq_compress(cast('some text' AS binary))) AS string) AS t, fq_checksum(cast('' AS binary)) AS c").first()
    assert (r.t, r.c) == ("some text", 0x51D8E999)
    blocks = spark.sql("SELECT f.* FROM VALUES (unhex('28b52ffd240001000099e9d851')) t(b), LATERAL fq_blocks(b) f").collect()
    assert [(x.block_type, x.last, x.size) for x in blocks] == [("raw", True, 0)]


def test_decoding_stops_at_the_room_given(spark):
    """A few bytes of run blocks would give 128 MiB; no more than the room is made."""
    bomb = bytes.fromhex("28b52ffd0088") + b"".join((2 | 131072 << 3).to_bytes(3, "little") + b"x" for _ in range(1023)) + (3 | 131072 << 3).to_bytes(3, "little") + b"x"
    assert len(bomb) < 5000
    df = frame_df(spark, [("bomb", bomb), ("fits", zstandard.ZstdCompressor().compress(b"y" * 1000)), ("null", None)])
    for o in (codec.DecompressOptions(), codec.DecompressOptions(plain=True)):
        out = {r.name: r.r for r in df.select("name", codec.decompress_into("b", F.lit(1000), o).alias("r")).collect()}
        assert out["bomb"] == (None, "DstSizeTooSmall") and out["null"] == (None, None) and bytes(out["fits"].data) == b"y" * 1000
        out = {r.name: r.r for r in df.select("name", codec.decompress("b", codec.replace(o, max_output=999)).alias("r")).collect()}
        assert out["bomb"].error_name == out["fits"].error_name == "DstSizeTooSmall"
    import resource

    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    with pytest.raises(walk.FrameError, match="DstSizeTooSmall"):
        codec.decode_all(bomb, codec.DecompressOptions(max_output=1 << 20))
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 64 << 10


def test_headers_run_in_generated_code(spark, tmp_path):
    """Filters and projections on headers of stored frames are whole-stage code, and need no Python."""
    frame_df(spark, [("a", zstandard.ZstdCompressor().compress(b"abc"))]).write.parquet(f"{tmp_path}/f")
    df = codec.guarded(spark.read.parquet(f"{tmp_path}/f"), "b", 1 << 20).select("name", fr.frame_header(F.col("b")).alias("h"))
    assert df.collect()[0].h.content_size == 3
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "lambda" not in plan
    lines = [x for x in plan.splitlines() if "Filter (" in x or "Project [" in x]
    assert lines and all("*(1)" in x for x in lines)


def test_headers_in_steps_are_the_same(spark):
    rng = random.Random(3)
    frames = [bytes.fromhex(h) for _, h, _ in GOLDEN] + [bytes.fromhex(h) for h in LEGACY_FRAMES.values()] + [rng.randbytes(rng.randint(0, 20)) for _ in range(50)]
    frames += [b"\x28\xb5\x2f\xfd" + rng.randbytes(rng.randint(0, 16)) for _ in range(300)] + [b"\x53\x2a\x4d\x18" + rng.randbytes(n) for n in (0, 3, 4, 9)]
    df = frame_df(spark, [(str(i), b) for i, b in enumerate([*frames, None])]).withColumn("a", fr.frame_header(F.col("b")))
    out = fr.with_frame_header(df, "b", "h")
    assert out.columns == ["name", "b", "a", "h"] and out.where(~F.col("a").eqNullSafe(F.col("h").cast(fr.HEADER_TYPE))).count() == 0


def test_offsets_of_a_hot_key(spark):
    rng = random.Random(4)
    rows = [("hot" if i % 3 else rng.choice(["a", None]), rng.randint(0, 10**9), rng.randint(0, 500)) for i in range(3000)]
    out = offsets.running_offsets(spark.createDataFrame(rows, "k string, i long, size int"), "k", "i", "size", 64).collect()
    want = {}
    for k in ("hot", "a", None):
        at = 0
        for n, (i, size) in enumerate(sorted((i, s) for x, i, s in rows if x == k)):
            want[k, n] = (i, size, at)
            at += size
    assert {(r.k, r.ord): (r.i, r.size, r.start_at) for r in out} == want


def test_contexts_and_names(spark):
    from framequarry import api

    c = api.CompressionContext().set_level(5).set_checksum(True).set_strategy("lazy").set_window_log(15).set_workers(2).set_search(hash_log=12)
    assert c.options == codec.CompressOptions(5, "lazy", True, 15, workers=2, hash_log=12)
    d = api.DecompressionContext().set_max_window_size(1 << 15).set_max_output(10_000)
    df = frame_df(spark, [("a", b"abc" * 3000), ("b", b"x" * 20_000)])
    out = {r.name: r.r for r in df.withColumn("f", c.compress("b")["data"]).select("name", d.decompress("f").alias("r")).collect()}
    assert bytes(out["a"].data) == b"abc" * 3000 and out["b"].error_name == "DstSizeTooSmall"
    for bad in (lambda: c.set_level(23), lambda: c.set_window_log(9), lambda: c.set_strategy("best")):
        with pytest.raises(ValueError, match="ParameterOutOfBound"):
            bad()
    assert c.set_pledged_size(3).reset().options == codec.CompressOptions()
    one = frame_df(spark, [("a", bytes.fromhex("28b52ffd24"))]).select(api.frames.detect(F.col("b")).alias("k"), api.legacy.supports_decode(F.lit(8)).alias("l")).first()
    assert (one.k, one.l) == ("zstd", False)
