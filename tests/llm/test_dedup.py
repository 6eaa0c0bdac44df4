from __future__ import annotations

import hashlib
import random
from collections import defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from framequarry.llm import _words, line_dedup, queries, simhash, substring_dedup
from framequarry.llm._bktree import BKForest
from framequarry.llm._common import row_ids
from framequarry.llm._components import connected_components


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


# Substring dedup


def slow_substrings(rows: list[tuple[int, str | None]], length: int = 20) -> dict[int, tuple[int, int, str]]:
    """Distinct ids only."""
    words = {i: (t or "").encode().split() for i, t in rows}
    seen, gone = set(), defaultdict(set)
    for i in sorted(words):
        w = words[i]
        for p in range(len(w) - length + 1):
            key = tuple(w[p : p + length])
            if key in seen:
                gone[i].update(range(p, p + length))
            seen.add(key)
    return {i: (len(w), len(gone[i]), b" ".join(x for p, x in enumerate(w) if p not in gone[i]).decode()) for i, w in words.items()}


def substrings(df, length: int = 20) -> dict:
    return {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in substring_dedup.substring_dedup(df, length=length).collect()}


def some_texts(seed: int, n: int = 120) -> list[tuple[int, str | None]]:
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdé", k=2))
    passages = [[word() for _ in range(rng.randint(5, 70))] for _ in range(12)]
    rows = []
    for i in range(n):
        w: list[str] = []
        for _ in range(rng.randint(0, 8)):
            w += rng.choice(passages)[rng.randint(0, 4) :] if rng.random() < 0.5 else [word() for _ in range(rng.randint(1, 40))]
        rows.append((i * 3, rng.choice([" ", "\n", "\t ", "\x0b"]).join(w)))
    return rows + [(1, None), (2, ""), (4, "same " * 100), (5, rows[3][1]), (7, rows[3][1])]


@pytest.mark.parametrize("chunk", [50, 1_500_000])
def test_substrings_match_brute_force(spark, monkeypatch, chunk):
    monkeypatch.setattr(substring_dedup, "CHUNK_WORDS", chunk)
    rows = some_texts(1)
    assert substrings(spark.createDataFrame(rows, "doc_id long, text string")) == slow_substrings(rows)
    assert substrings(spark.createDataFrame(rows, "doc_id long, text string"), 14) == slow_substrings(rows, 14)


def test_substrings_of_odd_rows(spark):
    t = " ".join(f"w{i}" for i in range(30))
    rows = [(None, t, "k"), (None, t, "l"), (5, t, "m"), (5, t, "n"), (6, t + " tail", "o"), (7, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_words string")
    out = sorted((r.doc_id is not None, r.doc_id or 0, r.n_words, r.n_removed) for r in substring_dedup.substring_dedup(df).collect())
    assert out == [(False, 0, 30, 0), (False, 0, 30, 0), (True, 5, 30, 30), (True, 5, 30, 30), (True, 6, 31, 30), (True, 7, 0, 0)]
    assert substring_dedup.substring_dedup(df.limit(0)).count() == 0
    extra = substring_dedup.substring_dedup(df.withColumnRenamed("n_words", "at_x")).collect()
    assert {r.at_x for r in extra} == {"k", "l", "m", "n", "o", None}


def own_ids(rows: list[tuple[int | None, str | None]]) -> list[tuple[int, str | None]]:
    """Rows with a null id under ids of their texts, below all others."""
    return [(-(2**63) + (xxhash.xxh64_intdigest((t or "").encode(), 42) >> 3) if i is None else i, t) for i, t in rows]


def test_substrings_of_many_rows_without_an_id(spark):
    rows = [(None if k % 3 == 0 and i > 5 else i, t) for k, (i, t) in enumerate(some_texts(6, 150)) if t]
    rows += [(None, rows[7][1]), (None, rows[8][1]), *rows[30:33]]
    want = slow_substrings(list(dict.fromkeys(own_ids(rows))))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = [(r.doc_id, r.n_words, r.n_removed, r.kept_text) for r in substring_dedup.substring_dedup(df).collect()]
    assert sorted(out, key=str) == sorted(((i, *want[j]) for (i, _), (j, _) in zip(rows, own_ids(rows), strict=True)), key=str)


def test_rows_without_an_id_do_not_meet(spark):
    rows = [(None if i % 3 == 0 else i, f"text {i}") for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string").select(row_ids("doc_id", "text").alias("id_"))
    sizes = [r["count"] for r in df.repartition(30, "id_").groupBy(F.spark_partition_id()).count().collect()]
    assert max(sizes) < 3 * 30 and df.distinct().count() == 900


def test_substrings_of_very_long_texts(spark):
    t = " ".join(f"w{i}" for i in range(200_000))
    df = spark.createDataFrame([(1, t), (2, "x " + t), (3, "y" * 3_000_000), (4, " " * 3_000_000 + "z")], "doc_id long, text string")
    assert {i: x[:2] for i, x in substrings(df).items()} == {1: (200_000, 0), 2: (200_001, 200_000), 3: (1, 0), 4: (1, 0)}


def test_packed_numbers():
    rng = np.random.default_rng(1)
    for top in (1, 200, 60_000, 2**31, 2**62):
        a = rng.integers(-top, top, 50)
        assert (_words.unpack_ints(_words.pack_ints(a)) == a).all()
        assert (_words.unpack_sorted(_words.pack_sorted(np.sort(a))) == np.sort(a)).all()
    edge = np.array([-(2**63), 0, 2**63 - 1])
    assert (_words.unpack_ints(_words.pack_ints(edge)) == edge).all()
    assert len(_words.unpack_sorted(_words.pack_sorted(a[:0]))) == 0


# Line dedup


def slow_lines(rows: list[tuple[int, str | None]]) -> dict:
    ws = " \t\n\x0b\f\r"
    key = lambda x: "".join(c.lower() if c.isascii() else c for c in x.strip(ws))
    holders = defaultdict(set)
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 20:
                holders[key(x)].add(i)
    out = {}
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(holders[key(x)]) >= 3 and max(holders[key(x)]) != i)]
        out[i] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


def line_rows(seed: int, n: int = 150) -> list[tuple[int, str | None]]:
    rng = random.Random(seed)
    pool = [("Line Number %d é " % i) * 2 for i in range(25)] + ["short", "", "  ", "Ünïcödé 1234567890123"]
    rows = [(i * 2, "\n".join(rng.choice(["", " ", "\t"]) + rng.choice([x, x.upper()]) for x in rng.choices(pool, k=rng.randint(0, 12)))) for i in range(n)]
    hot = "the one line that every document holds"
    return [(i, f"{t}\n{hot}\n{hot}") for i, t in rows] + [(1, None), (3, "")]


@pytest.mark.parametrize("partitions", [1, 4, 40])
def test_lines_match_brute_force(spark, partitions):
    rows = line_rows(2)
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        out = line_dedup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    finally:
        for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.execution.arrow.maxRecordsPerBatch"):
            spark.conf.unset(k)
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert {r.doc_id: (r.n_lines, r.n_dropped, r.kept_text) for r in out} == slow_lines(rows)


def test_bitmaps_say_what_stays(spark):
    rows = line_rows(3, 40)
    out = line_dedup.line_bitmaps(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = slow_lines(rows)
    for r in out:
        kept = line_dedup.unpack_bitmap(bytes(r.keep_bitmap), r.n_lines)
        assert (r.n_lines, int((~kept).sum())) == want[r.doc_id][:2]


def test_lines_of_odd_rows(spark):
    line = "a line of more than twenty characters"
    rows = [(None, line, 1), (None, line, 2), (5, line, 3), (5, "other\n" + line, 4), (9, line, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_lines int")
    out = sorted((r.doc_id or 0, r.n_lines, r.n_dropped) for r in line_dedup.deduplicated(df).collect())
    assert out == [(0, 1, 1), (0, 1, 1), (5, 1, 1), (5, 2, 1), (9, 1, 0)]
    assert line_dedup.deduplicated(df.limit(0)).count() == 0


def test_lines_of_many_rows_without_an_id(spark):
    rows = [(None if k % 3 == 0 else i, t) for k, (i, t) in enumerate(line_rows(7)) if t]
    rows = list({(i, t): None for i, t in rows})
    want = slow_lines(own_ids(rows))
    out = [(r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in line_dedup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(out, key=str) == sorted(((i, *want[j]) for (i, _), (j, _) in zip(rows, own_ids(rows), strict=True)), key=str)


def test_lines_of_very_long_texts(spark):
    long = "x" * 2_000_000
    rows = [(1, long), (2, long + "\n" + "\n" * 300_000), (3, " " + long.upper()), (4, " " * 2_000_000)]
    out = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_text) for r in line_dedup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == slow_lines(rows)


# SimHash


def slow_print(text: str | None, n: int = 3) -> int:
    words = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
    grams = [b" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))] if words else []
    out = 0
    for bit in range(64):
        if 2 * sum(xxhash.xxh64_intdigest(g, 42) >> bit & 1 for g in grams) > len(grams):
            out |= 1 << bit
    return out


def slow_components(prints: dict[int, int], radius: int) -> dict[int, int]:
    up = {i: i for i in prints}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in combinations(sorted(prints), 2):
        if (prints[a] ^ prints[b]).bit_count() <= radius:
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    return {i: root(i) for i in prints}


def test_simhash_query_matches_brute_force(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    prints = {i: slow_print(t) for i, t in docs.items()}
    want = slow_components(prints, 2)
    out = queries.op6_simhash_dedup(spark, sf_dir).collect()
    assert {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in out} == {i: (prints[i], want[i]) for i in docs}
    assert all(len(r.fingerprint) == 16 for r in out)


@pytest.mark.parametrize("seed", range(6))
def test_forest_finds_all_components(seed):
    rng = random.Random(seed)
    groups, prints = [], []
    for g in range(20):
        centres = [rng.getrandbits(64) for _ in range(rng.randint(1, 3))]
        members = {rng.choice(centres) ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for _ in range(rng.randint(1, 60))}
        members = list(members)
        rng.shuffle(members)
        groups += [g] * len(members)
        prints += members
    first = BKForest(np.array(groups), np.array(prints, np.uint64)[:, None]).components(2)
    for g in set(groups):
        at = [i for i, x in enumerate(groups) if x == g]
        want = slow_components({i: prints[i] for i in at}, 2)
        assert {i: int(first[i]) for i in at} == want


def test_routes_meet_within_the_radius():
    rng = random.Random(3)
    for radius in (0, 1, 2, 5):
        for _ in range(200):
            a = rng.getrandbits(64)
            b = a ^ sum(1 << x for x in rng.sample(range(64), radius))
            assert set(simhash._blocks(a.to_bytes(8), radius)) & set(simhash._blocks(b.to_bytes(8), radius))


def test_simhash_of_odd_rows(spark):
    rows = [(None, "a b c d", 1), (3, "A B C D", 2), (4, None, 3), (5, "", 4), (5, "", 5), (9, "q w e r t y", 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fingerprint int")
    out = [(r.doc_id, r.component_id) for r in simhash.simhash_components(df).collect()]
    assert sorted(out, key=str) == sorted([(None, None), (3, None), (4, 4), (5, 4), (5, 4), (9, 9)], key=str)
    assert simhash.simhash_components(df.limit(0)).count() == 0
    kept = simhash.one_of_each(df).collect()
    assert sorted((r.doc_id for r in kept), key=str) == [4, 9, None]


def test_simhash_query_takes_the_least_id_that_is_one(spark, tmp_path):
    rows = [(None, "a b c d"), (3, "A B C D"), (7, "a b c d"), (None, "q w e r t y"), (4, None), (None, ""), (9, " ")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = [(r.doc_id, r.component_id) for r in queries.op6_simhash_dedup(spark, str(tmp_path)).collect()]
    assert sorted(out, key=str) == sorted([(None, 3), (3, 3), (7, 3), (None, None), (4, 4), (None, 4), (9, 4)], key=str)


def test_different_texts_under_one_id_stay(spark):
    rng = random.Random(5)
    texts = [" ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(80)) for _ in range(6)]
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[1]), (7, texts[2]), (7, texts[3]), (8, texts[0]), (9, texts[1]), (10, texts[4])]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    want = {(None, texts[0]), (None, texts[1]), (7, texts[2]), (7, texts[3]), (10, texts[4])}
    for options in ({}, {"bits": 512, "ngram": 5, "radius": 108, "similarity": 0.8}):
        kept = [tuple(r) for r in simhash.one_of_each(df, **options).collect()]
        assert len(kept) == len(want) and set(kept) == want


def jaccard(a: str, b: str, n: int = 5) -> float:
    x, y = (set(simhash.shingle_hashes(t, n).tolist()) for t in (a, b))
    return len(x & y) / len(x | y)


def test_wide_radius_finds_near_copies_and_spares_others(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choices("abcdefghij", k=4))
    shared = [word() for _ in range(60)]
    rows, near = [], []
    for i in range(120):
        w = [word() for _ in range(300)] + (shared if i % 2 else [])
        rows.append((2 * i, " ".join(w)))
        c = list(w)
        for p in rng.sample(range(len(c)), rng.randint(3, 12)):
            c[p] = word()
        rows.append((2 * i + 1, " ".join(c)))
        near.append(jaccard(*(r[1] for r in rows[-2:])))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: r.component_id for r in simhash.simhash_components(df, bits=512, ngram=5, radius=92, similarity=0.8).collect()}
    hits = [out[2 * i + 1] == 2 * i for i in range(120)]
    assert sum(h for h, j in zip(hits, near, strict=True) if j >= 0.8) >= 0.98 * sum(j >= 0.8 for j in near)
    assert not any(h for h, j in zip(hits, near, strict=True) if j < 0.8)
    assert all(out[2 * i] == 2 * i for i in range(120))


def similar_pairs(texts: dict[int, str], n: int, least: float) -> set[tuple[int, int]]:
    """All pairs of texts whose sets of shingles have the similarity, by the shingles that they share."""
    sets = {i: set(simhash.shingle_hashes(t, n).tolist()) for i, t in texts.items()}
    at = defaultdict(list)
    for i in sorted(sets):
        for h in sets[i]:
            at[h].append(i)
    common = defaultdict(int)
    for ids in at.values():
        for a, b in combinations(ids, 2):
            common[a, b] += 1
    return {p for p, k in common.items() if k >= least * (len(sets[p[0]]) + len(sets[p[1]]) - k)}


def test_recall_of_the_pipelines_near_dedup_over_all_pairs(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir.replace('sf0.001', 'sf0.01')}/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    one = {}
    for i in sorted(texts):
        one.setdefault(texts[i], i)
    pairs = similar_pairs({i: t for t, i in one.items()}, corpus_pipeline.NEAR["ngram"], corpus_pipeline.NEAR["similarity"])
    found = {r.doc_id: r.component_id for r in simhash.simhash_components(docs, **corpus_pipeline.NEAR).collect()}
    assert len(pairs) >= 5
    assert sum(found[a] == found[b] for a, b in pairs) >= 0.99 * len(pairs)
    assert all(found[i] == found[one[t]] for i, t in texts.items())
    up = {i: i for i in one.values()}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in pairs:
        up[max(root(a), root(b))] = min(root(a), root(b))
    assert all(root(a) == root(found[a]) for a in one.values())  # nothing else is joined


def families(seed: int, n_families: int, n: int, low: float, high: float) -> list[tuple[int, str]]:
    """Texts that keep a part of their family's template, so that similarities lie on both sides of 0.8."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefghij", k=6))
    rows = []
    for _ in range(n_families):
        template = [word() for _ in range(300)]
        for _ in range(n):
            at, keep = rng.randint(0, 280), rng.uniform(low, high)
            w = list(template)
            w[at : at + round(300 * (1 - keep))] = [word() for _ in range(round(300 * (1 - keep)))]
            rows.append((len(rows), " ".join(w)))
    return rows


def all_components(rows: list[tuple[int, str]], similarity: float) -> dict[int, int]:
    """By every pair of texts."""
    up = {i: i for i, _ in rows}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in similar_pairs(dict(rows), 5, similarity):
        x, y = root(a), root(b)
        up[max(x, y)] = min(x, y)
    return {i: root(i) for i in up}


def candidate_components(rows: list[tuple[int, str]], radius: int, similarity: float) -> dict[int, int]:
    """By every pair that meets in a band and lies within the radius."""
    h = {i: np.unique(simhash.shingle_hashes(t, 5)) for i, t in rows}
    prints = {i: int.from_bytes(simhash.simhash(x, 512)) for i, x in h.items()}
    bands = {i: set(simhash._bands(x, 16, 5)) for i, x in h.items()}
    up = {i: i for i in h}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in combinations(sorted(h), 2):
        if bands[a] & bands[b] and (prints[a] ^ prints[b]).bit_count() <= radius:
            both = len(np.intersect1d(h[a], h[b]))
            if both >= similarity * (len(h[a]) + len(h[b]) - both):
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {i: root(i) for i in h}


@pytest.mark.parametrize(("seed", "block"), [(0, 1024), (1, 16)])
def test_no_link_is_lost_behind_one_that_fails(spark, monkeypatch, seed, block):
    """All that candidates join is joined, and nothing that no pair of the similarity joins."""
    monkeypatch.setattr(simhash, "BLOCK", block)
    rows = families(seed, 4, 60, 0.86, 0.92)
    least, most = candidate_components(rows, 92, 0.8), all_components(rows, 0.8)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r.doc_id: r.component_id for r in simhash.simhash_components(df, bits=512, ngram=5, radius=92, similarity=0.8).collect()}
    assert len(set(most.values())) > 8
    assert all(out[i] == out[least[i]] and most[i] == most[out[i]] for i in out)


def test_a_dense_group_of_failing_links_sends_few_rows(spark):
    """Texts of one template that are all a little too far from each other: no pairs leave the tasks that compare them."""
    rows = families(5, 1, 300, 0.84, 0.86)
    h = [np.unique(simhash.shingle_hashes(t, 5)) for _, t in rows]
    sent = [(1, 0, 0, i, i, 0, x.tobytes()) for i, x in enumerate(h)]
    batch = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*sent, strict=True)], names=["forest", "i", "j", "node", "component", "block", "set_"])
    out = [tuple(r.values()) for b in simhash._block_links(0.8)(iter([batch])) for r in b.to_pylist()]
    near = [(a, b) for a, b in combinations(range(len(h)), 2) if jaccard(rows[a][1], rows[b][1]) >= 0.8]
    assert len(out) < len(h) and set(out) <= set(near)
    assert len(set(all_components(rows, 0.8).values())) == len(h) - len(out)


def test_pairs_at_the_threshold_lie_within_the_pipelines_radius():
    rng = np.random.default_rng(4)
    far = []
    for _ in range(3000):
        h = rng.integers(0, 2**64, 300, np.uint64)
        a, b = (int.from_bytes(simhash.simhash(x, corpus_pipeline.NEAR["bits"])) for x in (h[:270], np.concatenate([h[:240], h[270:]])))
        far.append((a ^ b).bit_count())
    assert np.mean(np.array(far) > corpus_pipeline.NEAR["radius"]) < 0.001


def test_components_of_long_chains(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 200), (200, 300), (5, 5)]
    rng = random.Random(1)
    rng.shuffle(edges)
    out = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(out[i] == 0 for i in range(61)) and out[300] == out[200] == out[100] == 100
