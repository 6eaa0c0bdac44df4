"""Files as buffers: whole files in, frames out, and the other way round."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framequarry.operators.codec import CompressOptions, DecompressOptions, compress, decompress


def read_buffers(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, length, content of each file, by any file system that Spark reads."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "length", "content")


def read_decompressed(spark: SparkSession, path: str, options: DecompressOptions | None = None) -> DataFrame:
    """path, data, error_name of each compressed file; all frames of a file are decoded."""
    out = read_buffers(spark, path, "*.zst").withColumn("r", decompress("content", options))
    return out.select("path", F.col("r.data").alias("data"), F.col("r.error_name").alias("error_name"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of compressed or plain text files; Spark's own codec decodes *.zst."""
    return spark.read.text(path)


def compressed(df: DataFrame, bytes_col: str, options: CompressOptions | None = None) -> DataFrame:
    """df with `frame` in place of its buffer, and error_name."""
    rest = [c for c in df.columns if c not in {bytes_col, "frame", "error_name", "r_"}]
    return df.withColumn("r_", compress(bytes_col, options)).select(*rest, F.col("r_.data").alias("frame"), F.col("r_.error_name").alias("error_name"))


def write_parquet(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Parquet whose pages are compressed by the same format."""
    df.write.mode(mode).option("compression", "zstd").parquet(path)
