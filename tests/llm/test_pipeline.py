from __future__ import annotations

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from framequarry.llm import queries
from tests.llm.test_dedup import jaccard, slow_lines
from tests.llm.test_media_and_packing import check_pieces
from tests.llm.test_native import slow_figures

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def stage(spark, docs, k, sf_dir, tmp):
    corpus_pipeline.STAGES[k][1](spark, docs, sf_dir).write.parquet(f"{tmp}/{k}")
    return spark.read.parquet(f"{tmp}/{k}")


def test_every_stage_on_its_own_input(spark, sf_dir, tmp_path):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    one = stage(spark, docs, 0, sf_dir, tmp_path)
    ok = {r.doc_id for r in docs.collect() if not slow_figures(r.text)[5]}
    kept = {r.doc_id for r in one.collect()}
    assert kept <= ok and len(kept) >= 0.9 * len(ok) and one.columns == docs.columns
    two = stage(spark, one, 1, sf_dir, tmp_path)
    assert {r.doc_id: r.text for r in two.collect()} == {i: x[2] for i, x in slow_lines([(r.doc_id, r.text) for r in one.collect()]).items()}
    assert two.where(F.length("text") != F.col("n_chars")).count() == 0
    three = stage(spark, two, 2, sf_dir, tmp_path)
    texts = {r.doc_id: r.text for r in two.collect()}
    left = {r.doc_id for r in three.collect()}
    groups = defaultdict(list)
    for i, t in texts.items():
        groups[t].append(i)
    empty = [i for i, t in texts.items() if not t.split()]
    assert len(left & set(empty)) <= 1
    for ids in groups.values():
        assert len(left & set(ids)) <= 1
    for i in set(texts) - left:
        assert any(not texts[i].split() or jaccard(texts[i], t) >= 0.8 for j, t in texts.items() if j != i)
    four = stage(spark, three, 3, sf_dir, tmp_path)
    rows = {r.doc_id: r for r in three.collect()}
    chosen = [r.doc_id for r in four.collect()]
    assert len(chosen) == len(set(chosen)) and set(chosen) <= set(rows)
    tokens = lambda ids: sum(-(-len((rows[i].text or "").encode()) // 4) for i in ids)
    assert tokens(chosen) <= 0.9 * tokens(rows)
    five = corpus_pipeline.STAGES[4][1](spark, four, sf_dir).collect()
    tk = Tokenizer.from_file(queries.vocabulary_path())
    ids = {r.doc_id: [*tk.encode(r.text or "", add_special_tokens=False).ids, 1] for r in four.collect()}
    assert check_pieces(five, ids, 2048, 256, 2048) == 0


def test_odd_rows_pass_through(spark, sf_dir, tmp_path):
    rng = random.Random(2)
    body = lambda: " ".join(rng.choice(["the", "of"]) + " " + "".join(rng.choices("abcdef", k=5)) for _ in range(60))
    texts = [body() for _ in range(30)]
    rows = [(i, t, rng.choice(["en", None]), rng.choice(["src0", "src1", None]), len(t)) for i, t in enumerate(texts)]
    rows += [(50, texts[0], "en", "src0", 1), (51, texts[0], "en", "src0", 1), (51, texts[0], "en", "src0", 1), (None, texts[1], None, None, None), (None, None, None, None, None), (60, "", "de", "src3", 0), (61, body() * 200, "de", "src4", 9)]
    docs = spark.createDataFrame(rows, SCHEMA)
    for k in range(5):
        docs = stage(spark, docs, k, sf_dir, tmp_path)
        assert docs.count() > 0
        if k == 2:
            assert docs.where(F.col("doc_id").isin(50, 51)).count() == 1  # of its line the largest id keeps it


def test_null_and_repeated_ids_lose_no_text(spark, sf_dir, tmp_path):
    """Unrelated texts under null and repeated ids all come through; of equal and near ones, one does, whatever their ids are."""
    rng = random.Random(12)
    body = lambda: " ".join(rng.choice(["the", "of"]) + " " + "".join(rng.choices("abcdefghij", k=6)) for _ in range(60))
    texts = [body() for _ in range(40)]
    ids = [rng.choice([None, None, 5, 6, 100 + i]) for i in range(40)]
    rows = [(i, t, "en", "src1", len(t)) for i, t in zip(ids, texts, strict=True)]
    near = {k: texts[k] + " a few more words" for k in range(0, 10)}
    rows += [(rng.choice([None, 5, 900 + k]), t, "en", "src2", len(t)) for k, t in near.items()]
    rows += [(rng.choice([None, 5]), texts[k], "de", None, 1) for k in range(10, 20)]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, SCHEMA)
    one = stage(spark, docs, 0, sf_dir, tmp_path)
    assert sorted(map(str, one.collect())) == sorted(map(str, docs.collect()))
    two = stage(spark, one, 1, sf_dir, tmp_path)
    assert two.count() == len(rows) and {r.text for r in two.collect()} >= set(texts) - {t for t in texts if sum(r[1] == t for r in rows) > 2}
    three = stage(spark, two, 2, sf_dir, tmp_path)
    left = [r.text for r in three.collect()]
    assert len(left) == len(set(left)) == 40
    assert all((t in left) + (near.get(k) in left) == 1 for k, t in enumerate(texts))
    four = stage(spark, three, 3, sf_dir, tmp_path)
    assert 30 <= four.count() <= 40
    pieces = corpus_pipeline.STAGES[4][1](spark, four, sf_dir).collect()
    whole = [r for r in pieces if r.start == 0]
    assert len(whole) == four.count() and sum(r.length for r in pieces) == sum(r.doc_tokens for r in whole)


@pytest.mark.parametrize("k", range(5))
def test_empty_tables(spark, sf_dir, k):
    assert corpus_pipeline.STAGES[k][1](spark, spark.createDataFrame([], SCHEMA), sf_dir).count() == 0


def test_run(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.count() > 0
