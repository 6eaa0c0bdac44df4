"""Byte statistics: histograms, entropy, normalised counts and length-limited prefix codes.

Counting is one aggregation per buffer with map-side sums; what is iterative (normalising, limiting lengths) runs on the 256 counts of a buffer, never on its bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Table sizes, as powers of two.
LOG_MIN, LOG_MAX, LOG_DEFAULT = 5, 12, 11
CODE_DEPTH = 11


def _count_bytes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for i in range(0, whole.num_rows, 512):
            b = whole.slice(i, 512)
            at, symbol, n = [], [], []
            for k, x in enumerate(b.column("bytes_").to_pylist()):
                counts = np.bincount(np.frombuffer(x or b"", np.uint8), minlength=256)
                found = np.flatnonzero(counts)
                at.append(np.full(len(found), k))
                symbol.append(found)
                n.append(counts[found])
            take = pa.array(np.concatenate(at) if at else [], pa.int64())
            names = [c for c in b.schema.names if c != "bytes_"]
            made = [pa.array(np.concatenate(x) if x else [], t) for x, t in ((symbol, pa.int32()), (n, pa.int64()))]
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(take) for c in names), *made], names=[*names, "symbol", "n"])


def byte_counts(df: DataFrame, bytes_col: str) -> DataFrame:
    """df's other columns with symbol and n: one row per distinct byte of each buffer, without a shuffle."""
    rest = [c for c in df.columns if c not in {bytes_col, "bytes_", "symbol", "n"}]
    schema = df.select(*rest).schema.add("symbol", "integer").add("n", "long")
    return df.select(*rest, F.col(bytes_col).cast("binary").alias("bytes_")).mapInArrow(_count_bytes, schema)


def byte_histogram(df: DataFrame, bytes_col: str, keys: list[str], max_symbol: int = 255) -> DataFrame:
    """keys, symbol, n over all buffers of a key. Bytes above max_symbol are left out."""
    counts = byte_counts(df.select(*keys, bytes_col), bytes_col).where(F.col("symbol") <= max_symbol)
    return counts.groupBy(*keys, "symbol").agg(F.sum("n").alias("n"))


def histogram_facts(histogram: DataFrame, keys: list[str]) -> DataFrame:
    """keys with cardinality, largest, total, max_symbol and entropy in bits a byte."""
    total = F.sum("n").over(Window.partitionBy(*keys))
    share = F.col("n") / total
    rows = histogram.withColumn("bits", -share * F.log2(share))
    return rows.groupBy(*keys).agg(
        F.count("*").alias("cardinality"), F.max("n").alias("largest"), F.sum("n").alias("total"), F.max("symbol").alias("max_symbol"), F.sum("bits").alias("entropy")
    )


def is_uniform(b: Column) -> Column:
    """Whether a buffer is one byte repeated; false if it is empty."""
    digits = F.hex(b)
    return (F.octet_length(b) > 0) & (digits == F.repeat(F.substring(digits, 1, 2), F.octet_length(b)))


def min_table_log(total: int, max_symbol: int) -> int:
    """The fewest bits in which a table can hold the symbols."""
    return LOG_MIN if total <= 1 else min(total.bit_length(), max_symbol.bit_length() + 1)


def optimal_table_log(total: int, max_symbol: int, wanted: int = LOG_DEFAULT) -> int:
    if total <= 1:
        return LOG_MIN
    log = min(wanted, max((total - 1).bit_length() - 3, 0))
    return max(LOG_MIN, min(LOG_MAX, max(log, min_table_log(total, max_symbol))))


def normalized(counts: np.ndarray, log: int) -> np.ndarray:
    """Counts scaled to a sum of 2**log by largest remainder: each present symbol has 1, and its share of what is left. Of equal remainders the smaller symbol's counts first."""
    present = np.flatnonzero(counts)
    if not len(present) or len(present) > 1 << log:
        raise ValueError("the table is too small")
    share = [divmod(int(c) * ((1 << log) - len(present)), int(counts.sum())) for c in counts[present]]
    out = np.zeros(len(counts), np.int64)
    out[present] = [1 + whole for whole, _ in share]
    over = (1 << log) - int(out.sum())
    out[sorted(present.tolist(), key=dict(zip(present.tolist(), (-rest for _, rest in share), strict=True)).get)[:over]] += 1
    return out


def code_lengths(counts: np.ndarray, depth: int = CODE_DEPTH) -> np.ndarray:
    """Prefix-code lengths of at most `depth` bits with the least total, by package-merge."""
    present = sorted((int(c), s) for s, c in enumerate(counts.tolist()) if c)
    out = np.zeros(len(counts), np.int64)
    if len(present) == 1:
        out[present[0][1]] = 1
    if len(present) < 2:
        return out
    if len(present) > 1 << depth:
        raise ValueError("the depth is too small")
    leaves = [(c, (s,)) for c, s in present]
    level: list = []
    for _ in range(depth):
        level = sorted(leaves + [(a[0] + b[0], a[1] + b[1]) for a, b in zip(level[::2], level[1::2], strict=False)], key=lambda x: x[0])
    for _, symbols in level[: 2 * len(present) - 2]:
        for s in symbols:
            out[s] += 1
    return out


def _per_buffer(df: DataFrame, keys: list[str], schema: str, each) -> DataFrame:
    """each(counts) on the 256 counts of every key; rows of (key, symbol, value)."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        counts = np.zeros(256, np.int64)
        counts[pdf["symbol"].to_numpy()] = pdf["n"].to_numpy()
        values = each(counts)
        found = np.flatnonzero(counts)
        out = pd.DataFrame({"symbol": found.astype(np.int32), "n": counts[found], "value": values[found]})
        for k in keys:
            out[k] = pdf[k].iloc[0]
        return out[[*keys, "symbol", "n", "value"]]

    return df.groupBy(*keys).applyInPandas(run, schema)


def _schema(df: DataFrame, keys: list[str]) -> str:
    types = dict(df.dtypes)
    return ", ".join([*(f"{k} {types[k]}" for k in keys), "symbol int", "n long", "value long"])


def table_log(total: Column, max_symbol: Column, wanted: int = LOG_DEFAULT) -> Column:
    """optimal_table_log as an expression."""
    bits = lambda x: F.when(x > 0, F.length(F.bin(x))).otherwise(0)
    least = F.least(bits(total), bits(max_symbol) + 1)
    log = F.least(F.lit(wanted), F.greatest(bits(total - 1) - 3, F.lit(0)))
    return F.when(total <= 1, LOG_MIN).otherwise(F.greatest(F.lit(LOG_MIN), F.least(F.lit(LOG_MAX), F.greatest(log, least))))


def normalized_counts(histogram: DataFrame, keys: list[str], log: int | None = None) -> DataFrame:
    """keys, symbol, n, value: counts scaled to 2**log (default: table_log) as by `normalized`, null if a key has more symbols than that. Windows over the 256 counts of a key."""
    of_key = Window.partitionBy(*keys)
    facts = histogram.withColumns({"total": F.sum("n").over(of_key), "present": F.count("*").over(of_key), "top": F.max("symbol").over(of_key).cast("long")})
    size = F.lit(1 << log) if log else F.pow(F.lit(2), table_log(F.col("total"), F.col("top"))).cast("long")
    share = F.col("n").cast("decimal(20,0)") * (F.col("size") - F.col("present"))
    parts = facts.withColumn("size", size.cast("long")).select("*", F.floor(share / F.col("total")).cast("long").alias("whole"), (share % F.col("total")).cast("long").alias("rest"))
    over = F.col("size") - F.col("present") - F.sum("whole").over(of_key)
    placed = parts.withColumns({"over": over, "place": F.row_number().over(of_key.orderBy(F.desc("rest"), "symbol"))})
    value = 1 + F.col("whole") + F.when(F.col("place") <= F.col("over"), 1).otherwise(0)
    return placed.select(*keys, "symbol", "n", F.when(F.col("present") <= F.col("size"), value).alias("value"))


def huffman_lengths(histogram: DataFrame, keys: list[str], depth: int = CODE_DEPTH) -> DataFrame:
    """keys, symbol, n, value: code lengths."""
    return _per_buffer(histogram, keys, _schema(histogram, keys), lambda counts: code_lengths(counts, depth))


def symbol_order(histogram: DataFrame, keys: list[str]) -> DataFrame:
    """keys, symbol, n and the symbol's place from the most frequent down; of equal counts the smaller symbol comes first."""
    return histogram.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), "symbol")))


def payload_bytes(lengths: DataFrame, keys: list[str]) -> DataFrame:
    """keys with the bytes of the coded payload and the codes' Kraft sum, in shares of 2**depth."""
    return lengths.groupBy(*keys).agg(
        F.ceil(F.sum(F.col("n") * F.col("value")) / 8).alias("payload_bytes"), F.sum(F.pow(F.lit(2), CODE_DEPTH - F.col("value"))).cast("bigint").alias("kraft")
    )


def symbol_prices(histogram: DataFrame, keys: list[str]) -> DataFrame:
    """keys, symbol and its price in quarter bits, rounded down."""
    total = F.sum("n").over(Window.partitionBy(*keys))
    return histogram.withColumn("price", F.floor(4 * F.log2(total / F.col("n")) + 1e-9).cast("bigint"))
