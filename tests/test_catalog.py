"""Every query against its SQL, and the parts that SQL cannot express against plain Python."""

from __future__ import annotations

import heapq
import random
import shutil
from collections import Counter

import duckdb
import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

import __spark_entry__
from framequarry import catalog
from framequarry.operators import codec, dictionary, gear, prepared, stats, tables, walk
from framequarry.operators.decoder import StreamDecoder
from framequarry.sources import files
from framequarry.streaming.chunks import compress_stream, decompress_stream

TABLES = ("documents", "benchmark", "events", "orders")


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_matches_its_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    got = con.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in got.description]
    cols = sorted(names)
    want = sorted((tuple(plain(r[names.index(c)]) for c in cols) for r in got.fetchall()), key=str)
    df = catalog.queries()[name](spark, sf_dir)
    assert sorted(df.columns) == cols
    assert sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=str) == want


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_gear_splits_are_the_rolling_ones():
    table = [(i + 1) * gear.PRIME % 2**64 for i in range(256)]
    for n in (0, 63, 64, 65, 5000):
        data = random.Random(n).randbytes(n)
        h, want = gear.SEED, []
        for i, b in enumerate(data):
            h = ((h << 1) + table[b]) % 2**64
            if i >= gear.MIN_MATCH and h & gear.stop_mask(7) == 0:
                want.append(i + 1)
        assert gear.split_points(data).tolist() == want


def test_repeated_chunks(spark):
    body = random.Random(1).randbytes(20_000)
    df = spark.createDataFrame([(1, bytearray(body)), (2, bytearray(b"other start" + body)), (3, None)], "doc_id long, b binary")
    out = gear.repeated_chunks(gear.splits(df, "b"), "doc_id").collect()
    assert sum(r.end - r.start for r in out if r.doc_id == 2) > 0.85 * len(body)
    for r in out:
        assert r.first_id == 1 and (b"other start" + body)[r.start : r.end] == body[r.first_start : r.first_start + r.end - r.start]


@pytest.mark.parametrize("seed", range(30))
def test_normalised_counts(seed):
    rng = random.Random(seed)
    counts = np.zeros(256, np.int64)
    for s in rng.sample(range(256), rng.randint(1, 256)):
        counts[s] = rng.choice([1, 2, 5, 100, 10_000])
    log = stats.optimal_table_log(int(counts.sum()), 255)
    log = max(log, int(np.ceil(np.log2(max(2, (counts > 0).sum())))) + 1, 5)
    out = stats.normalized(counts, log)
    assert out.sum() == 1 << log and ((out > 0) == (counts > 0)).all()
    exact = counts * ((1 << log) - (counts > 0).sum()) / counts.sum()
    assert (np.abs(out - (counts > 0) - exact) < 1).all()


def test_normalised_counts_as_windows(spark):
    rng = random.Random(3)
    keys = {k: {s: rng.choice([1, 2, 5, 100, 10**6]) for s in rng.sample(range(256), rng.randint(1, 200))} for k in range(12)} | {99: {7: 3}}
    df = spark.createDataFrame([(k, s, n) for k, c in keys.items() for s, n in c.items()], "k int, symbol int, n long")
    for log in (None, 9, 5):
        out = {(r.k, r.symbol): r.value for r in stats.normalized_counts(df, ["k"], log).collect()}
        for k, c in keys.items():
            counts = np.zeros(256, np.int64)
            counts[list(c)] = list(c.values())
            size = log or stats.optimal_table_log(int(counts.sum()), max(c))
            want = stats.normalized(counts, size) if len(c) <= 1 << size else None
            assert all(out[k, s] == (None if want is None else want[s]) for s in c)


@pytest.mark.parametrize("seed", range(30))
def test_code_lengths_are_optimal_within_the_depth(seed):
    rng = random.Random(seed)
    counts = np.array([rng.choice([0, 1, 3, 50, 1000]) for _ in range(rng.randint(2, 60))] + [5, 6])
    n = stats.code_lengths(counts, 11)
    used = n[counts > 0]
    assert (used > 0).all() and used.max() <= 11 and sum(2.0 ** -int(x) for x in used) == 1
    free = stats.code_lengths(counts, 40)
    heap = [int(c) for c in counts if c]
    heapq.heapify(heap)
    best = 0
    while len(heap) > 1:
        s = heapq.heappop(heap) + heapq.heappop(heap)
        best += s
        heapq.heappush(heap, s)
    assert int((free * counts).sum()) == best <= int((n * counts).sum())


def test_trainers_pick_recurring_chunks(spark):
    hot, cold = "recurring-header-payload-AAAA", "zzzz qqqq wwww xxxx"
    df = spark.createDataFrame([(i, bytearray(s.encode())) for i, s in enumerate([hot, hot, hot, cold])], "id long, b binary")
    d = dictionary.build(df, dictionary.cover_selection(df, "id", "b", 6, 14, 128), "id", "b", 9)
    assert d[:8] == bytes.fromhex("37a430ec09000000") and b"recurring" in d[8:22]
    fast = dictionary.build(df, dictionary.fast_cover_selection(df, "id", "b", 6, 100, 6, 2, 64), "id", "b", 0)
    assert b"recurring" in fast and len(fast) <= 72
    assert dictionary.build(df.limit(0), dictionary.naive_selection(df.limit(0), "id", "b"), "id", "b", 0) is None


def test_streams_in_any_order(spark, tmp_path):
    rng = random.Random(4)
    whole = {s: rng.randbytes(n) for s, n in (("a", 300_000), ("b", 0), ("c", 5), ("d", 131_072))}
    rows = []
    for s, data in whole.items():
        parts = [data[i : i + 50_000] for i in range(0, len(data), 50_000)] or [b""]
        rows += [(s, i, bytearray(p), i == len(parts) - 1) for i, p in enumerate(parts)]
    rng.shuffle(rows)
    schema = "stream_id string, chunk_no long, chunk binary, is_last boolean"
    for k in range(3):
        spark.createDataFrame(rows[k::3], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    def run(stream, name):
        q = stream.writeStream.format("parquet").option("path", f"{tmp_path}/{name}").option("checkpointLocation", f"{tmp_path}/{name}-state").trigger(availableNow=True).start()
        q.awaitTermination()
        return spark.read.schema(stream.schema).parquet(f"{tmp_path}/{name}")

    made = run(compress_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")), "c")
    again = spark.readStream.schema(made.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/c")
    back = run(decompress_stream(again.select("stream_id", F.col("seq").alias("chunk_no"), F.col("data").alias("chunk"), F.col("done").alias("is_last"))), "d").collect()
    got = Counter()
    for s, data in whole.items():
        assert b"".join(bytes(r.data) for r in sorted((r for r in back if r.stream_id == s), key=lambda r: r.seq)) == data
        got[s] = sum(r.done for r in back if r.stream_id == s)
    assert set(got.values()) == {1} and all(r.error_name is None for r in back)
    shutil.rmtree(tmp_path)


def test_broken_stream_ends_with_an_error(spark, tmp_path):
    schema = "stream_id string, chunk_no long, chunk binary, is_last boolean"
    spark.createDataFrame([("x", 0, bytearray(bytes.fromhex("28b52ffd2419c90000")), True), ("y", 0, bytearray(b"junk junk"), True)], schema).write.parquet(f"{tmp_path}/in")
    stream = decompress_stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"))
    q = stream.writeStream.format("parquet").option("path", f"{tmp_path}/o").option("checkpointLocation", f"{tmp_path}/s").trigger(availableNow=True).start()
    q.awaitTermination()
    out = {r.stream_id: r.error_name for r in spark.read.parquet(f"{tmp_path}/o").collect()}
    assert out == {"x": "SrcSizeWrong", "y": "PrefixUnknown"}


def test_files(spark, tmp_path):
    import zstandard

    (tmp_path / "a.zst").write_bytes(zstandard.compress(b"one\n") + zstandard.compress(b"two\n"))
    (tmp_path / "b.txt").write_bytes(b"plain\n")
    out = files.read_decompressed(spark, str(tmp_path)).collect()
    assert [(bytes(r.data), r.error_name) for r in out] == [(b"one\ntwo\n", None)]
    assert {r.value for r in files.read_lines(spark, f"{tmp_path}/b.txt").collect()} == {"plain"}
    buffers = files.read_buffers(spark, str(tmp_path), "*.txt")
    files.write_parquet(files.compressed(buffers, "content"), f"{tmp_path}/out")
    assert bytes(zstandard.decompress(bytes(spark.read.parquet(f"{tmp_path}/out").first().frame))) == b"plain\n"


def _run_stream(spark, stream, folder):
    q = stream.writeStream.format("parquet").option("path", f"{folder}/o").option("checkpointLocation", f"{folder}/s").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/o").orderBy("stream_id", "seq").collect()


def test_flushed_bytes_can_be_read_before_the_end(spark, tmp_path):
    """Three micro-batches: what a flush lets out decodes at once, the whole is one frame, and a chunk that comes again after the end opens nothing."""
    rng = random.Random(6)
    parts = [" ".join(rng.choices(["alpha", "beta", "gamma", "delta"], k=2000)).encode() for _ in range(3)]
    rows = [("s", 0, bytearray(parts[0]), False, True), ("s", 1, bytearray(parts[1]), False, False), ("s", 2, bytearray(parts[2]), True, False), ("s", 1, bytearray(parts[1]), False, True)]
    schema = "stream_id string, chunk_no long, chunk binary, is_last boolean, flush boolean"
    for r in rows:
        spark.createDataFrame([r], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = compress_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in"), codec.CompressOptions(strategy="lazy", checksum=True))
    out = _run_stream(spark, stream, tmp_path / "a")
    assert [r.done for r in out] == [False, True]
    first = bytes(out[0].data)
    assert zstandard.ZstdDecompressor().decompressobj().decompress(first) == parts[0]
    whole = first + bytes(out[1].data)
    assert zstandard.ZstdDecompressor().decompressobj().decompress(whole) == b"".join(parts)
    assert len(list(walk.walk(whole))) == 1 and len(whole) < 0.5 * sum(map(len, parts))


def test_pledged_streams(spark, tmp_path):
    schema = "stream_id string, chunk_no long, chunk binary, is_last boolean"
    spark.createDataFrame([("fits", 0, bytearray(b"12345"), True), ("short", 0, bytearray(b"123"), True), ("long", 0, bytearray(b"1234567"), True)], schema).write.parquet(f"{tmp_path}/in")
    stream = compress_stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), codec.CompressOptions(pledged=5))
    out = {r.stream_id: r for r in _run_stream(spark, stream, tmp_path / "a")}
    assert out["short"].error_name == out["long"].error_name == "SrcSizeWrong"
    assert walk.read_header(bytes(out["fits"].data)).content == 5


@pytest.mark.parametrize("size", [1, 7, 5000])
def test_stream_decoder_takes_any_pieces(size):
    """Regular, skippable and concatenated frames in pieces of any size, by blocks."""
    data = random.Random(1).randbytes(3000) + b"abc" * 50_000
    c = zstandard.ZstdCompressor(level=3, write_checksum=True)
    buffer = c.compress(data[: 20_000 if size < 100 else None]) + bytes.fromhex("502a4d1803000000616263") + c.compress(b"tail")
    d, out = StreamDecoder(), b""
    for i in range(0, len(buffer), size):
        out += d.feed(buffer[i : i + size])
    assert d.idle and out == data[: 20_000 if size < 100 else None] + b"tail"


def test_streams_that_stay_away_are_given_up(spark, tmp_path):
    import time

    schema = "stream_id string, chunk_no long, chunk binary, is_last boolean"
    spark.createDataFrame([("open", 0, bytearray(b"never ended"), False)], schema).write.mode("append").parquet(f"{tmp_path}/in")
    stream = compress_stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), idle_ms=500)
    q = stream.writeStream.format("parquet").option("path", f"{tmp_path}/o").option("checkpointLocation", f"{tmp_path}/s").trigger(processingTime="1 second").start()
    try:
        end = time.time() + 60
        out = []
        while not out and time.time() < end:
            time.sleep(1)
            spark.createDataFrame([(f"tick{time.time()}", 0, bytearray(b"x"), True)], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            out = [r for r in spark.read.schema(stream.schema).parquet(f"{tmp_path}/o").collect() if r.stream_id == "open"] if (tmp_path / "o").exists() else []
    finally:
        q.stop()
    assert [(r.done, r.error_name) for r in out] == [(True, "SrcSizeWrong")]


def test_prepared_dictionaries():
    rng = random.Random(2)
    samples = [" ".join(rng.choices(["header", "payload", "value", "key", "end", "start"], k=40)).encode() for _ in range(400)]
    raw = zstandard.train_dictionary(4096, samples, dict_id=77).as_bytes()
    d = prepared.prepare(raw)
    assert d.dict_id == 77 and raw.endswith(d.content) and set(d.entropy_tables) == {"ll", "of", "ml", "literals"} and all(0 < r <= len(d.content) for r in d.repeats)
    z = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_FULLDICT)
    o = codec.DecompressOptions(dictionary=raw, standard=True)
    for s in samples[:40]:
        frame = zstandard.ZstdCompressor(dict_data=z).compress(s)
        assert codec.decode_frame(frame, codec.replace(o, plain=True)) == s == codec.decode_frame(frame, o)
        own = codec.encode(s, codec.CompressOptions(dictionary=raw, standard=True, plain=True, strategy="lazy"))
        assert zstandard.ZstdDecompressor(dict_data=z).decompress(own) == s and len(own) < len(codec.encode(s, codec.CompressOptions(plain=True, strategy="lazy")))
    assert prepared.from_content(b"raw").entropy_tables == {} and prepared.from_content(b"raw").repeats == (1, 4, 8)
    for broken, name in ((raw[:20], "DictionaryCorrupted"), (b"raw content", "InvalidDictionary"), (raw[: -len(d.content)], "DictionaryCorrupted"), (raw[:4], "InvalidDictionary")):
        with pytest.raises(walk.FrameError, match=name):
            prepared.prepare(broken)
    with pytest.raises(walk.FrameError, match="DictionaryWrong"):
        codec.decode_frame(frame, codec.DecompressOptions(dictionary=zstandard.train_dictionary(4096, samples, dict_id=78).as_bytes(), standard=True))


@pytest.mark.parametrize("seed", range(4))
def test_long_matches(seed):
    rng = random.Random(seed)
    blocks = [rng.randbytes(rng.randint(800, 3000)) for _ in range(6)]
    data = b"".join(rng.choice(blocks) + rng.randbytes(rng.randint(0, 50)) for _ in range(40))
    for window in (1 << 13, 1 << 40):
        found = gear.matches_of(data, window)
        done = 0
        for start, length, distance in found:
            assert start >= done and 0 < distance <= min(start, window) and length >= gear.MIN_MATCH
            assert data[start : start + length] == data[start - distance : start - distance + length]
            assert start + length == len(data) or data[start + length] != data[start + length - distance]
            done = start + length
    assert sum(n for _, n, _ in found) > 0.6 * len(data)


@pytest.mark.parametrize("name", ["plain_encoder", "plain_decoder", "roundtrip_checksum", "dict_roundtrip", "prepared_dictionary", "plain_strategies", "legacy_roundtrip"])
def test_coders_in_python_use_all_cores(spark, sf_dir, name):
    plan = __spark_entry__.queries()[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and "hashpartitioning(doc_id" in plan


def test_few_values_are_held_at_once():
    taken = []
    rows = ((taken.append(i) or bytes(1 << 20), None) for i in range(600))
    for k, piece in enumerate(codec._by_value(rows, codec._RESULT_TYPES)):
        assert len(piece) == 4 and len(taken) == 4 * (k + 1)
    assert len(taken) == 600
    assert [len(x) for x in codec._by_value(((None, "x") for _ in range(600)), codec._RESULT_TYPES)] == [256, 256, 88]


def test_frames_of_a_buffer_stay_together(spark):
    frames = [codec.encode(bytes([65 + i % 26]) * i, codec.CompressOptions()) for i in range(300)]
    df = spark.createDataFrame([(1, bytearray(b"".join(frames))), (2, bytearray(b"")), (3, bytearray(frames[0] + b"x"))], "i long, b binary")
    each = sorted(map(tuple, tables.frames(df, "b").collect()))
    listed = {r.i: [(r.i, *f) for f in r.frames] for r in tables.frame_lists(df, "b").collect()}
    assert sorted(x for rows in listed.values() for x in rows) == each
    assert [f[4] for f in listed[1]] == list(map(len, frames))
    assert listed[2] == [] and listed[3][-1][-1] == "SrcSizeWrong"


@pytest.mark.parametrize("word", ["a", "ab ", "Ñíue ", "same line of some words\n", "0123456789" * 30])
def test_long_matches_of_texts_without_split_points(word):
    rng = random.Random(3)
    for tail in ("", "".join(rng.choices("abcdefghij ", k=700)), "xyz" * 500):
        text = (word * (5000 // len(word.encode()) + 1) + tail).encode()
        data = text + text
        found = gear.matches_of(data, 1 << 27)
        assert sum(n for _, n, _ in found) >= 0.8 * len(text)
        assert all(0 < d <= at and data[at : at + n] == data[at - d : at - d + n] for at, n, d in found)
    h = gear._hashes(data)
    assert gear._lowest(h, 128).tolist() == [h[i : i + 128].min() for i in range(len(h))]


def test_one_frame_of_one_large_buffer(spark):
    rng = random.Random(8)
    words = ["".join(rng.choices("abcdefghij", k=5)) for _ in range(200)]
    data = " ".join(rng.choices(words, k=100_000)).encode()
    df = spark.createDataFrame([(1, bytearray(data)), (2, bytearray(b"")), (3, bytearray(b"short"))], "i long, b binary")
    for checksum in (False, True):
        out = {r.i: r for r in codec.compress_one_frame(df, "i", "b", 3, codec.CompressOptions(strategy="greedy", checksum=checksum), 100_000).collect()}
        assert out[1].num_jobs > 1 and out[2].num_jobs == out[3].num_jobs == 1
        for i, want in ((1, data), (2, b""), (3, b"short")):
            frame = bytes(out[i].frame)
            assert zstandard.ZstdDecompressor().decompressobj().decompress(frame) == want
            assert len(list(walk.walk(frame))) == 1 and walk.read_header(frame).content == len(want) and walk.read_header(frame).checksum == checksum
        assert len(out[1].frame) < 1.05 * len(codec.encode(data, codec.CompressOptions(strategy="greedy", plain=True)))
