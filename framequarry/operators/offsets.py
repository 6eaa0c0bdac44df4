"""Where frames lie in a buffer that is never put together in one place: running sums of their sizes.

A buffer is a key's frames in the order of a number. Sizes are summed by slices of that order first; only the slices' sums, of which there are at most `slices` for a key, meet in one task,
and each slice is then summed on its own. So a key with a third of all frames is spread over its slices.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SLICES = 4096


def running_offsets(df: DataFrame, key: str, order_col: str, size_col: str, slices: int = SLICES) -> DataFrame:
    """df with ord (the frames of its key before it) and start_at (their bytes). order_col: whole numbers; frames of one number are taken in the order of their sizes."""
    ends = df.agg(F.min(order_col).alias("low_"), F.max(order_col).alias("high_"))
    width = F.greatest(F.ceil((F.col("high_") - F.col("low_") + 1) / F.lit(slices)), F.lit(1))
    cut = df.crossJoin(ends).withColumn("slice_", F.floor((F.col(order_col) - F.col("low_")) / width)).drop("low_", "high_")  # a one-row side
    sums = cut.groupBy(key, "slice_").agg(F.count("*").alias("n_"), F.sum(F.col(size_col).cast("long")).alias("bytes_"))
    before = Window.partitionBy(key).orderBy("slice_").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col(key).alias("key_"), F.col("slice_").alias("s_"), *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in ("n_", "bytes_")])
    joined = cut.join(sums, F.col(key).eqNullSafe(F.col("key_")) & F.col("slice_").eqNullSafe(F.col("s_")))
    inside = Window.partitionBy(key, "slice_").orderBy(order_col, size_col).rowsBetween(Window.unboundedPreceding, -1)
    ord_ = F.col("n_") + F.coalesce(F.count("*").over(inside), F.lit(0))
    start = F.col("bytes_") + F.coalesce(F.sum(F.col(size_col).cast("long")).over(inside), F.lit(0))
    return joined.withColumns({"ord": ord_, "start_at": start}).select(*[c for c in df.columns if c not in ("ord", "start_at")], "ord", "start_at")
