"""Shared helpers of the training-data operators."""

from __future__ import annotations

import tempfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six bytes that separate words: space and \x09 to \x0D.
WHITESPACE = " \t\n\x0b\f\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
#: Stands for a null id inside the operators: it sorts before every other id.
NULL_ID = -(2**63)


def row_ids(id_col: str, text_col: str) -> Column:
    """The id as a bigint. Rows with a null id get one by their text, below all ids from -2**63 + 2**61 on: a third of all rows may have none, and they must not meet in one task."""
    own = F.shiftrightunsigned(F.xxhash64(F.col(text_col).cast("string")), 3) + F.lit(NULL_ID)
    return F.coalesce(F.col(id_col).cast("long"), own)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The folder for checkpoints, as the session names it.

    Only a single-machine session without that setting gets a temporary folder; on a cluster the setting is needed.
    """
    sc = spark.sparkContext
    if (there := sc.getCheckpointDir()) is not None:
        return there
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="checkpoints-")
    sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Cuts the lineage of df by a reliable checkpoint in the shared folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once: a lambda variable holds it, so Catalyst can't copy the expression into each use."""
    return F.element_at(F.transform(F.array(value), body), 1)


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z; other characters stay as they are."""
    return F.translate(text, UPPER, LOWER)


def word_array(text: Column) -> Column:
    """The words `[^\\x20\\x09-\\x0D]+` of a text; none if it is null."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), WHITESPACE[1:], "     "), " "), "")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
