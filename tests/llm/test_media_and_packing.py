from __future__ import annotations

import hashlib
import json
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from framequarry.llm import ogg, packing, queries


def slow_checksum(data: bytes) -> int:
    crc = 0
    for x in data:
        crc ^= x << 24
        for _ in range(8):
            crc = (crc << 1 ^ (0x04C11DB7 if crc & 0x80000000 else 0)) & 0xFFFFFFFF
    return crc


@given(st.binary(max_size=300))
def test_checksum_is_the_bitwise_one(data):
    assert ogg.page_checksum(data) == slow_checksum(data)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 70_000), st.integers(1, 4))
def test_round_trip(n, streams):
    payload = random.Random(n).randbytes(n)
    read, faults = ogg.read_ogg(ogg.write_ogg(payload, streams))
    assert ogg.payload_of(read) == payload
    assert not faults
    assert sum(s.granule for s in read) == n
    assert len(read) == streams


def test_times_follow_granules():
    read, _ = ogg.read_ogg(ogg.write_ogg(bytes(10_000), 2))
    assert read[0].starts[1:] == [0, 1000, 2000, 3000, 4000]
    assert [len(p) for p in read[0].packets[1:]] == [1000] * 5


def test_broken_pages_are_found():
    media = bytearray(ogg.write_ogg(random.Random(1).randbytes(50_000), 2))
    media[5000] ^= 1
    read, faults = ogg.read_ogg(bytes(media))
    assert faults["bad_checksum"] == 1
    assert faults["lost_pages"] == 1
    assert faults["granule_gap"] >= 1
    _, faults = ogg.read_ogg(ogg.write_ogg(b"abc" * 900)[:-5])
    assert faults["truncated"] == 1 and faults["unended"]
    assert ogg.read_ogg(b"no pages here")[1] == {"skipped_bytes": 13}
    assert ogg.read_ogg(b"")[0] == []


def test_packets_over_many_pages():
    ident = ogg._IDENT.pack(ogg._MAGIC, ogg.RATE, 1, 0, 1, 60_000)
    packets = [bytes(50_000), bytes(255 * 64), b"x"]
    media = b"".join(p for _, p in ogg._stream_pages(7, ident, packets))
    read, faults = ogg.read_ogg(media)
    assert read[0].packets[1:] == packets and not faults


def test_media_columns(spark):
    rows = [(1, b"abc", "x"), (2, None, "y"), (3, b"", "z"), (1, b"abc", "x")]
    df = spark.createDataFrame(rows, "doc_id long, payload binary, feature string")
    out = ogg.from_ogg(ogg.to_ogg(df, "payload")).orderBy("doc_id").collect()
    assert [bytes(r.payload) for r in out] == [b"abc", b"abc", b"", b""]
    assert all(r.faults == "" for r in out)
    packets = ogg.ogg_packets(ogg.to_ogg(df.where("doc_id = 1").limit(1), "payload")).orderBy("serial", "packet_no").collect()
    assert [bytes(r.packet) for r in packets if r.packet_no == 1] == [b"abc"]
    assert ogg.from_ogg(ogg.to_ogg(df.limit(0), "payload")).count() == 0


def test_query_holds_the_payload(spark, sf_dir):
    texts = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    out = queries.op1_ogg_media(spark, sf_dir).collect()
    assert len(out) == len(texts)
    for r in out:
        t = texts[r.doc_id]
        p = t + bytes(-len(t) % 64 if t else 64)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(t), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
        assert r.faults == ""


def test_very_long_values(spark):
    rows = [(1, bytearray(random.Random(1).randbytes(4_000_000))), (2, None), (3, bytearray(b"\0" * 3_000_000))]
    out = {r.i: r for r in ogg.from_ogg(ogg.to_ogg(spark.createDataFrame(rows, "i int, b binary"), "b")).collect()}
    assert all(bytes(out[i].payload) == bytes(b or b"") and out[i].faults == "" for i, b in rows)


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.vocabulary_path())


ODD_TEXTS = ["", " ", "a", "<|endoftext|>", "x <|endoftext|>y", "don't  stop\n\n\t ", "   ​", "日本語 ñandú 😀😀", "a" * 5000, " " * 300, "1234567890 ²³ ½", "\r\n\r\n", "\x85\x1c\x1f"]


def test_ids_are_those_of_the_tokenizers_library(spark, sf_dir, tokenizer):
    texts = ODD_TEXTS + [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    code = packing.encoder(queries.vocabulary_path())
    for t in texts:
        assert code(t).tolist() == tokenizer.encode(t, add_special_tokens=False).ids


LONG = {
    "spaces": " " * 10**6 + "a",
    "newlines": "b" + "\n" * 10**6 + "a",
    "only spaces": " " * 10**6,
    "letters": "ab" * 300_000,
    "digits and dots": "7" * 200_000 + "." * 200_000,
    "mixed": (" \n\t\u3000" * 1000 + "x") * 50,
    "before a special token": "a" + "\t" * 2000 + "<|endoftext|>" + " " * 2000 + "<|endoftext|>" + "word " * 20_000 + " " * 1500,
    "at the limit": "".join("w" + " " * n for n in range(990, 1010)) + "x" * packing.LONG_TEXT,
    "other controls": "a" + " \x1c" * 2000 + "\x85\xa0" * 800 + "b " * 50_000,
}


@pytest.mark.parametrize("name", LONG)
def test_ids_of_long_runs(tokenizer, name):
    assert packing.encoder(queries.vocabulary_path())(LONG[name]).tolist() == tokenizer.encode(LONG[name], add_special_tokens=False).ids


def test_long_runs_do_not_end_the_task(spark, tokenizer):
    rows = [(1, LONG["spaces"]), (2, "a b"), (3, LONG["newlines"])]
    ids = {i: [*tokenizer.encode(t, add_special_tokens=False).ids, 1] for i, t in rows}
    out = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), queries.vocabulary_path()).collect()
    assert check_pieces(out, ids, 2048, 256, 2048) == 0


@pytest.mark.parametrize("change", ["merges", "prefix", "normalizer"])
def test_other_vocabulary_files_are_run_by_their_library(tmp_path, change):
    from tokenizers import Tokenizer

    spec = json.load(open(queries.vocabulary_path(), encoding="utf-8"))
    if change == "merges":
        spec["model"]["merges"] = spec["model"]["merges"][1000:] + spec["model"]["merges"][:1000]
    elif change == "prefix":
        spec["pre_tokenizer"]["add_prefix_space"] = True
    else:
        spec["normalizer"] = {"type": "Lowercase"}
    path = str(tmp_path / "v.json")
    json.dump(spec, open(path, "w", encoding="utf-8"))
    text = "The quick brown Fox, 12 times  over."
    assert packing.encoder(path)(text).tolist() == Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids


def test_prompts_of_conversations_under_binding_limits(spark, sf_dir, tokenizer):
    """Instruction data: a conversation's turns but the last are its prompt. Both further limits bind, as the counts without them go beyond."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").where("text IS NOT NULL")
    whole = turns.groupBy(F.col("conv_id").alias("doc_id")).agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    said = lambda c: F.array_join(F.transform(c, lambda x: F.concat(x["role"], F.lit(": "), x["text"], F.lit("\n"))), "")
    rows = whole.select("doc_id", said(F.col("t")).alias("text"), said(F.slice("t", 1, F.size("t") - 1)).alias("prompt"))
    ids = {r.doc_id: [*tokenizer.encode(r.text, add_special_tokens=False).ids, 1] for r in rows.collect()}
    per = lambda out, f: max(f([r for r in out if r.sequence_id == s]) for s in {r.sequence_id for r in out})
    loss_of = lambda x: sum(r.loss_tokens for r in x)
    free = packing.pack(rows, queries.vocabulary_path(), prompt_col="prompt").collect()
    segments, loss = per(free, len) - 1, per(free, loss_of) // 2
    assert segments > 1 and loss > 50
    for s, n in ((segments, 2048), (256, loss), (segments, loss)):
        tight = packing.pack(rows, queries.vocabulary_path(), prompt_col="prompt", segments=s, loss=n).collect()
        assert check_pieces(tight, ids, 2048, s, n) == 0
        assert per(tight, len) == s or per(tight, loss_of) > 0.9 * n


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_ids_of_any_text(text):
    from tokenizers import Tokenizer

    global _HF
    _HF = globals().get("_HF") or Tokenizer.from_file(queries.vocabulary_path())
    assert packing.encoder(queries.vocabulary_path())(text).tolist() == _HF.encode(text, add_special_tokens=False).ids


def check_pieces(out, ids: dict[int, list[int]], length: int, segments: int, loss: int) -> int:
    """All contracts of a packing; returns the padding."""
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in out:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
        assert r.length > 0
    for doc, want in ids.items():
        at = 0
        for r in sorted(by_doc[doc], key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(want)
            assert r.ids_crc32 == zlib.crc32(np.array(want[at : at + r.length], "<u4").tobytes())
            at += r.length
        assert at == len(want)
    padding = 0
    for rows in by_seq.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= length and len(rows) <= segments and sum(r.loss_tokens for r in rows) <= loss
        padding += 0 if at & (at - 1) == 0 else length - at
    return padding


def test_query_packs_every_id(spark, sf_dir, tokenizer):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    ids = {r.doc_id: [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 1] for r in docs}
    out = queries.op8_vector_packing(spark, sf_dir).collect()
    assert check_pieces(out, ids, 2048, 256, 2048) == 0
    assert len({r.sequence_id for r in out}) < sum(map(len, ids.values())) / 2048 + 40


def test_packing_limits_and_odd_rows(spark, tokenizer):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choice(["ab", "cde", "x"]) for _ in range(rng.randint(0, 90))), "ab cde") for i in range(700)] + [(700, None, None), (701, "", ""), (702, "word " * 4000, "word word")]
    df = spark.createDataFrame(rows, "doc_id long, text string, prompt string").repartition(3)
    ids = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for i, t, _ in rows}
    out = packing.pack(df, queries.vocabulary_path(), prompt_col="prompt", length=256, segments=6, loss=100).collect()
    assert check_pieces(out, ids, 256, 6, 100) == 0
    assert packing.pack(df.limit(0), queries.vocabulary_path()).count() == 0
    twice = packing.pack(spark.createDataFrame([(None, "a b"), (None, "a b")], "doc_id long, text string"), queries.vocabulary_path()).collect()
    assert sum(r.length for r in twice) == 6 and all(r.doc_id is None and r.doc_tokens == 3 for r in twice)
