"""The plain decoder against the codec library and known frames."""

from __future__ import annotations

import random

import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st

from framequarry.operators import codec
from framequarry.operators.decoder import decode_regular
from framequarry.operators.historic import decode_legacy
from framequarry.operators.historic_writer import VERSIONS, block_of, encode_historic, frame_of
from framequarry.operators.walk import LEGACY_BOUND, FrameError, bound, legacy_of
from framequarry.plans.golden import GOLDEN, LEGACY_FRAMES

LEGACY_TEXT = (
    "snowden is snowed in / he's now then in his snow den / when does the snow end?\ngoodbye little dog / you dug some holes in your day / they'll be hard to fill.\n"
    "when life shuts a door, / just open it. it’s a door. / that is how doors work.\n"
).encode()


def some_bodies() -> list[bytes]:
    rng = random.Random(1)
    words = ["alpha", "beta", "gamma", "delta", "epsilon", "the", "of", "and"]
    text = " ".join(rng.choice(words) for _ in range(9000)).encode()
    mixed = b"".join(bytes([rng.randrange(256)]) * rng.randint(1, 60) for _ in range(3000))
    return [b"", b"x", b"ab" * 500, text, text[:700], mixed, rng.randbytes(3000), bytes(200_000), text * 6, bytes(rng.choice(b"abcd") for _ in range(20_000))]


@pytest.mark.parametrize("level", [-3, 1, 3, 6, 12, 19])
def test_agrees_with_the_library(level):
    for body in some_bodies():
        frame = zstandard.ZstdCompressor(level=level, write_checksum=True).compress(body)
        assert decode_regular(frame) == body


def test_raw_content_dictionary():
    d = b"some words that many samples have in common, over and over " * 8
    body = b"samples have in common, over and over some words that many"
    c = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT), level=9)
    assert decode_regular(c.compress(body), d) == body


@pytest.mark.parametrize(("name", "frame", "want"), GOLDEN)
def test_known_frames(name, frame, want):
    b = bytes.fromhex(frame)
    if want is None:
        with pytest.raises(FrameError):
            decode_regular(b)
    else:
        assert len(decode_regular(b)) == want


@pytest.mark.parametrize("version", range(1, 8))
def test_historic_frames(version):
    b = bytes.fromhex(LEGACY_FRAMES[version])
    assert legacy_of(b) == version
    assert decode_legacy(b) == (LEGACY_TEXT, len(b))
    assert codec.decode_all(zstandard.compress(b"before ") + b + zstandard.compress(b"after"), codec.DecompressOptions()) == b"before " + LEGACY_TEXT + b"after"
    assert bound(b + zstandard.compress(b"after") + b) == 2 * LEGACY_BOUND + 5
    for cut in (1, 10, 100):
        with pytest.raises(FrameError):
            decode_legacy(b[:-cut])
        with pytest.raises(FrameError, match="SrcSizeWrong"):
            bound(b[:-cut])


@settings(max_examples=300, deadline=None)
@given(st.integers(1, 7), st.integers(0, 10**6), st.integers(0, 7))
def test_damaged_historic_frames_never_crash(version, place, bit):
    b = bytearray.fromhex(LEGACY_FRAMES[version])
    b[4 + place % (len(b) - 4)] ^= 1 << bit
    try:
        assert len(decode_legacy(bytes(b))[0]) <= 1 << 17
    except FrameError:
        pass


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 10**6), st.integers(0, 7))
def test_damage_never_goes_unnoticed_or_crashes(place, bit):
    body = b"words and more words, " * 40 + bytes(range(256))
    frame = bytearray(zstandard.ZstdCompressor(write_checksum=True).compress(body))
    frame[place % len(frame)] ^= 1 << bit
    try:
        assert decode_regular(bytes(frame)) == body
    except FrameError:
        pass


def flat_frame(version: int, literals: bytes, sequences: list[tuple[int, int, int]]) -> bytes:
    return frame_of(version, [(0, block_of(version, literals, sequences))])


def replay(literals: bytes, sequences: list[tuple[int, int, int]]) -> bytes:
    out, at = bytearray(), 0
    for count, back, length in sequences:
        out += literals[at : at + count]
        at += count
        for _ in range(length):
            out.append(out[-back])
    return bytes(out + literals[at:])


LONG = [(5, 3, 4), (70, 60, 140), (400, 333, 500), (1, 470, 131), (40_000, 9, 33_000), (63, 40_000, 386)]


@pytest.mark.parametrize("version", [2, 3, 4, 5])
def test_long_lengths_of_historic_frames(version):
    literals = bytes(random.Random(5).randrange(97, 123) for _ in range(41_000))
    frame = flat_frame(version, literals, LONG)
    assert decode_legacy(frame) == (replay(literals, LONG), len(frame))


@pytest.mark.parametrize("version", [4, 5])
def test_historic_frames_against_the_codec_of_the_jvm(spark, version):
    literals = bytes(random.Random(6).randrange(97, 123) for _ in range(41_000))
    repeats = [(9, 7, 9), (3, 0, 5), (0, 0, 6), (4, 8, 12), (0, 0, 4), (2, 0, 4), (0, 5, 8), (0, 0, 4), (6, 0, 9), (2, 11, 4)]
    for sequences in (LONG, repeats):
        frame = flat_frame(version, literals, sequences)
        got = bytes(spark._jvm.com.github.luben.zstd.Zstd.decompress(frame, 200_000))
        assert decode_legacy(frame)[0] == got


@pytest.mark.parametrize("version", [4, 5])
@pytest.mark.parametrize("kind", range(4))
def test_kinds_of_historic_tables(spark, version, kind):
    """Three sequences of 5 literals and a match of 4, two or three bytes back, all three tables as one symbol each; other kinds must be refused."""
    literals = b"abcdefghijklmnopqrst"
    body = (len(literals) << 2 | 1).to_bytes(3, "little") if version < 5 else (0b1011 << 20 | len(literals)).to_bytes(3, "big")
    body += literals + (b"\x03\x00" if version < 5 else b"\x03") + bytes([kind * 0b01010100, 0, 5, 2, 0, 0b1101])
    frame = bytes.fromhex(LEGACY_FRAMES[version])[:4] + b"\x08" + len(body).to_bytes(3, "big") + body + b"\xc0\x00\x00"

    def ours():
        return decode_legacy(frame)[0]

    def theirs():
        return bytes(spark._jvm.com.github.luben.zstd.Zstd.decompress(frame, 1000))

    if kind == (2 if version < 5 else 1):
        assert ours() == theirs() == replay(literals, [(5, 3, 4), (5, 2, 4), (5, 3, 4)])
    else:
        with pytest.raises(FrameError):
            ours()
        with pytest.raises(Exception, match="ZstdException"):
            theirs()


@pytest.mark.parametrize("version", VERSIONS)
def test_historic_writer(spark, version):
    for body in some_bodies():
        frame = encode_historic(body, version)
        assert decode_legacy(frame) == (body, len(frame))
        assert len(frame) <= len(body) + 16 + 3 * (len(body) // (1 << 17))
        if version > 3 and body:
            assert bytes(spark._jvm.com.github.luben.zstd.Zstd.decompress(frame, len(body))) == body
    assert len(encode_historic(b"some text, " * 500, version)) < 100
    rows = spark.createDataFrame([(1, bytearray(b"abc" * 50)), (2, None), (3, bytearray())], "id int, b binary")
    got = {r.id: r.r for r in rows.select("id", codec.compress_historic("b", version).alias("r")).collect()}
    assert bytes(got[1].data) == encode_historic(b"abc" * 50, version) and got[2].data is None and decode_legacy(bytes(got[3].data))[0] == b""


@pytest.mark.parametrize("version", [1, 6, 7, 8])
def test_versions_that_are_not_written(version):
    with pytest.raises(FrameError, match="VersionUnsupported"):
        encode_historic(b"abc", version)


@settings(max_examples=150, deadline=None)
@given(st.sampled_from(VERSIONS), st.lists(st.sampled_from([b"a", b"bc", b"some words ", b"\x00" * 90, b"xyz" * 150]), max_size=60).map(b"".join))
def test_historic_round_trips(version, body):
    assert decode_legacy(encode_historic(body, version))[0] == body
