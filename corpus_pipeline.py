"""From raw documents to packed training sequences: quality rules, line dedup, near-dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next stage's docs. All but the last return the
columns of documents.

Defined cases, in all stages: null and repeated ids are allowed, and different texts under one id stay different documents; a null text is an empty one; texts of any length are taken
whole; an empty table gives an empty result. What is special to a stage is said there.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framequarry.llm import line_dedup, mixing, packing, quality, simhash
from framequarry.llm._common import ensure_checkpoint_dir, read_table
from framequarry.llm.queries import MIX_SEED, MIX_WEIGHTS, domain_of, vocabulary_path

#: Share of the remaining tokens that the mixture takes. No document is given twice.
BUDGET = 0.9
#: Links of at most 108 of 512 bits are candidates (a similarity of 0.8 differs in 77 or so with a deviation of 8); their sets of five-word shingles are then compared.
NEAR = {"bits": 512, "ngram": 5, "radius": 108, "similarity": 0.8}


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go, those without a text among them; repeated rows are judged each on its own, a figure at its threshold passes."""
    return quality.passing_documents(docs)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go from the texts; documents stay, if with an empty text. Of rows with one id, each loses its own lines; the largest id keeps a line, and null ids are the least."""
    out = line_dedup.deduplicated(docs)
    return out.withColumns({"text": F.col("kept_text"), "n_chars": F.length("kept_text").cast("long")}).select(*docs.columns)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the least by id (null ids first) and hash of the text. Equal rows count as one; of documents without words one stays."""
    return simhash.one_of_each(docs, **NEAR).select(*docs.columns)


def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents by the sources' budgets, each row at most once. A null language or source is a value of its own; ties of the order hash go by id and size."""
    rows = docs.withColumns({"domain": domain_of(F.col("source")), "n_tokens": mixing.byte_tokens(F.col("text"))})
    return mixing.mix(rows, BUDGET, MIX_WEIGHTS, 1, MIX_SEED).select(*docs.columns)


def pack_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences. A document without a text has the end id alone; a null id stays null."""
    return packing.pack(docs, vocabulary_path())


STAGES = [
    ("quality_rules", quality_stage),
    ("line_dedup", line_stage),
    ("simhash_dedup", near_stage),
    ("source_mixing", mix_stage),
    ("vector_packing", pack_stage),
]

#: Near-dedup needs components, packing a tokenizer: SQL has neither.
ORACLE_SQL = None


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, with the tables between them in the shared checkpoint folder.

    A stage's table is deleted when the next one is written, which needs it no more; the last stage's input stays, as the result is read from it.
    """
    docs = read_table(spark, sf_dir, "documents")
    folder = f"{ensure_checkpoint_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            _delete(spark, before)
        before = f"{folder}/{name}"
    return STAGES[-1][1](spark, docs, sf_dir)
