"""The plain encoder against the codec library and the plain decoder."""

from __future__ import annotations

import pickle
import random

import numpy as np
import pytest
import xxhash
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st

from framequarry.functions.parameters import STRATEGIES
from framequarry.operators import encoder as en
from framequarry.operators.decoder import Bits, decode_regular, read_counts, read_stream, read_tree
from framequarry.operators.hashes import XXH64
from framequarry.operators.stats import code_lengths, normalized
from framequarry.operators.walk import FrameError, read_blocks, read_header


def library(frame: bytes, dictionary: bytes = b"") -> bytes:
    d = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if dictionary else None
    return zstandard.ZstdDecompressor(dict_data=d).decompressobj().decompress(frame)


def prose(seed: int, n: int) -> bytes:
    rng = random.Random(seed)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9))) for _ in range(300)]
    return " ".join(rng.choices(words, k=n // 6)).encode()


BODIES = {
    "empty": b"",
    "one": b"x",
    "run": b"a" * 200_000,
    "short": b"abcabcabcabcabc",
    "prose": prose(1, 60_000),
    "two blocks": prose(2, 180_000),
    "noise": random.Random(3).randbytes(5000),
    "few symbols": bytes(random.Random(4).choices(b"ab", k=3000)),
    "all symbols": bytes(range(256)) * 40,
    "high bytes": "ñandú größer éàü ".encode() * 500,
    "long match": (lambda x: x + x)(random.Random(5).randbytes(9000)),
    "skewed": bytes(random.Random(6).choices([0, 1, 2, 200, 255], [1000, 50, 20, 2, 1], k=9000)),
    "256 literals": random.Random(7).randbytes(128) * 2,
}


@pytest.mark.parametrize("strategy", STRATEGIES)
@pytest.mark.parametrize("name", BODIES)
def test_frames_are_read_back(name, strategy):
    data = BODIES[name] if strategy in ("fast", "lazy", "btopt") else BODIES[name][:40_000]
    frame = en.encode_frame(data, strategy, checksum=True)
    assert library(frame) == data == decode_regular(frame)
    assert zstandard.get_frame_parameters(frame).content_size == len(data)
    assert len(frame) <= len(data) + 20
    if name in ("prose", "two blocks", "run", "long match", "few symbols", "skewed", "high bytes"):
        assert len(frame) < 0.6 * len(data)


def test_stronger_strategies_give_less():
    data = prose(9, 60_000)
    size = {s: len(en.encode_frame(data, s)) for s in STRATEGIES}
    assert size["btopt"] < size["lazy"] < size["fast"] and all(x <= 1.01 * size["fast"] for x in size.values())
    assert size["lazy"] < 1.25 * len(zstandard.ZstdCompressor(level=6).compress(data))


@settings(max_examples=150, deadline=None)
@given(st.binary(max_size=400), st.integers(1, 30), st.sampled_from(STRATEGIES), st.booleans(), st.booleans())
def test_any_bytes(part, times, strategy, checksum, declared):
    data = part * times
    frame = en.encode_frame(data, strategy, checksum, content_size=declared)
    assert library(frame) == data == decode_regular(frame)


@pytest.mark.parametrize("window_log", [10, 12, 17])
def test_no_match_goes_beyond_the_window(window_log):
    rng = random.Random(window_log)
    data = b"".join(rng.choice([rng.randbytes(700), prose(1, 2000)]) for _ in range(300))
    frame = en.encode_frame(data, "lazy", window_log=window_log, content_size=False)
    assert read_header(frame).window == 1 << window_log
    assert library(frame) == data == decode_regular(frame)


def test_dictionary_content():
    d = prose(4, 3000)
    data = d[500:1500] + b" and so on " + d[:200]
    frame = en.encode_frame(data, "greedy", dictionary=d)
    assert library(frame, d) == data == decode_regular(frame, d)
    assert len(frame) < len(en.encode_frame(data, "greedy"))


@pytest.mark.parametrize("seed", range(20))
def test_table_descriptions(seed):
    rng = random.Random(seed)
    counts = np.array([rng.choice([0, 0, 0, 1, 5, 300]) for _ in range(rng.randint(2, 53))] + [3])
    log = max(5, int((counts > 0).sum() - 1).bit_length() + 1, rng.randint(5, 9))
    norm = normalized(counts, log).tolist()
    b = en.write_counts(norm, log)
    assert read_counts(b + b"\0\0", 255, 12) == (norm, log, len(b))


@pytest.mark.parametrize("seed", range(40))
def test_trees(seed):
    rng = random.Random(seed)
    counts = np.zeros(256, np.int64)
    for s in rng.sample(range(rng.choice([20, 129, 130, 256])), rng.randint(2, 20)):
        counts[s] = rng.choice([1, 3, 90, 4000])
    lengths = code_lengths(counts, 11)
    head = en.tree_description(lengths)
    if head is None:
        assert np.flatnonzero(lengths)[-1] > 128
        return
    tree = read_tree(head + b"\0")
    assert tree[2] == len(head)
    data = np.array(rng.choices(np.flatnonzero(counts).tolist(), k=500), np.uint8)
    assert read_stream(en.packed(en.tree_codes(lengths)[data], lengths[data]), tree, 500) == data.tobytes()


def test_bits_are_read_in_order():
    rng = random.Random(1)
    widths = [rng.randint(0, 31) for _ in range(500)]
    values = [rng.getrandbits(w) if w else 0 for w in widths]
    bits = Bits(en.packed(np.array(values), np.array(widths)))
    assert [bits.read(w) for w in widths] == values and bits.left == 0


@pytest.mark.parametrize("checksum", [False, True])
def test_streams_are_one_frame(checksum):
    rng = random.Random(2)
    data, at, out = prose(3, 400_000), 0, b""
    stream = en.StreamEncoder("greedy", 17, checksum)
    flushed = []
    while at < len(data):
        n = rng.randint(1, 60_000)
        flush = rng.random() < 0.3
        out += stream.write(data[at : at + n], flush)
        at += n
        if flush:
            flushed.append((len(out), at))
        stream = pickle.loads(pickle.dumps(stream))
    out += stream.write(b"", end=True)
    assert library(out) == data == decode_regular(out)
    assert len(out) < 0.5 * len(data)
    for size, n in flushed:  # all that came before a flush can be read
        assert zstandard.ZstdDecompressor().decompressobj().decompress(out[:size]) == data[:n]
    blocks = list(read_blocks(out, read_header(out).size))
    assert [b[2] for b in blocks] == [False] * (len(blocks) - 1) + [True]
    again = stream.write(b"next frame", end=True)
    assert library(again) == b"next frame"


def test_pledged_sizes_and_resets():
    stream = en.StreamEncoder("fast", pledged=10)
    out = stream.write(b"12345", flush=True) + stream.write(b"67890", end=True)
    assert read_header(out).content == 10 and library(out) == b"1234567890"
    for bad in (b"123456789", b"12345678901"):
        stream.reset()
        with pytest.raises(ValueError, match="SrcSizeWrong"):
            stream.write(bad, end=True)
    stream = en.StreamEncoder("fast")
    stream.write(b"dropped")
    stream.reset()
    assert library(stream.write(b"kept", end=True)) == b"kept"
    assert library(stream.write(b"", end=True)) == b""


def test_jobs_make_one_frame():
    """Blocks of later jobs know the bytes before them but not the repeats, and are put after each other."""
    data = prose(8, 500_000)
    cuts = [0, 130_000, 260_000, 300_000, len(data)]
    parts = []
    for k, (i, j) in enumerate(zip(cuts, cuts[1:], strict=False)):
        state = en.BlockState() if not k else en.BlockState([None] * 3)
        parts.append(en.encode_blocks(data[i:j], data[max(0, i - 65536) : i], j == len(data), state, 1 << 20, "lazy"))
    frame = en.frame_head(len(data), 20, False) + b"".join(parts)
    assert library(frame) == data == decode_regular(frame)
    alone = [en.encode_blocks(data[i:j], b"", True, en.BlockState(), 1 << 20, "lazy") for i, j in zip(cuts, cuts[1:], strict=False)]
    assert len(frame) < len(b"".join(alone))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.binary(max_size=100), max_size=6), st.integers(0, 2**64 - 1))
def test_xxh64_in_steps(parts, seed):
    h = XXH64(seed)
    for p in parts:
        h = pickle.loads(pickle.dumps(h.update(p)))
    assert h.digest() == xxhash.xxh64_intdigest(b"".join(parts), seed)


def test_a_frame_that_is_cut_off_is_an_error():
    frame = en.encode_frame(prose(1, 2000), "lazy")
    with pytest.raises(FrameError):
        decode_regular(frame[:-5])
