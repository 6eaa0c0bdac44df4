"""Sharding by extendible hashing: a directory indexed by hash-prefix bits, in which only oversized buckets split on another bit.

The first 60 bits come from the id's MD5. They decide until none are left; the next 60 come from the row's text, so only rows that are equal in both id and text share all
120. Bytes are first summed by the next `step` bits (map-side), so what is exchanged is one row per prefix. A bucket ends at the shortest prefix whose bytes fit;
prefixes that don't fit after `step` bits go on to the next round, alone. Rows that share all bits overflow into pages of equal size, numbered by two-level counts, so
no hot id is gathered in one task. All of it is built-in expressions.

`directory` gives the slots of the result's buckets.

Defined cases: null ids hash as the text "null", null texts count no bytes, long ones all of theirs; equal rows may lie in different overflow pages; a row larger than the limit is a page of its own;
further columns stay; columns with the result's names are replaced; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framequarry.llm._common import checkpointed

BITS = 60


def hash_bits(value: Column) -> Column:
    """60 bits of the value's MD5, as a bigint."""
    return F.conv(F.substring(F.md5(value.cast("binary")), 1, BITS // 4), 16, 10).cast("long")


def _leaves(rows: DataFrame, limit: int, step: int, used: int) -> DataFrame:
    """For the cells of the next `step` bits below each parent: the least number of those bits whose prefix fits, null if none does."""
    key = F.col("h1") if used < BITS else F.col("h2")
    cell = F.shiftright(key, BITS - used % BITS - step).bitwiseAND((1 << step) - 1)
    cells = rows.groupBy("parent", cell.alias("cell")).agg(F.sum("bytes_").alias("bytes_"))
    deep = cells.select("parent", "cell", "bytes_", F.explode(F.sequence(F.lit(1), F.lit(step))).alias("depth"))
    at = Window.partitionBy("parent", "depth", F.expr(f"shiftright(cell, {step} - depth)"))
    fits = deep.withColumn("total", F.sum("bytes_").over(at)).where(F.col("total") <= limit)
    return cells.select("parent", "cell").join(fits.groupBy("parent", "cell").agg(F.min("depth").alias("depth"), F.max("total").alias("total")), ["parent", "cell"], "left")


def extendible_shards(df: DataFrame, limit: int, id_col: str = "doc_id", text_col: str = "text", step: int = 12) -> DataFrame:
    """df without its text, with n_bytes, shard (the bits of its prefix, and `/page` for overflow), depth and shard_bytes."""
    names = {"n_bytes", "shard", "depth", "shard_bytes", "h1", "h2", "parent", "bytes_", "pid", text_col}
    rest = [c for c in df.columns if c not in names]
    rows = df.select(
        *rest,
        F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("bytes_"),
        hash_bits(F.coalesce(F.col(id_col).cast("string"), F.lit("null"))).alias("h1"),
        hash_bits(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("h2"),
        F.lit("").alias("parent"),
        F.spark_partition_id().alias("pid"),
    )
    rows = checkpointed(rows)
    whole = rows.agg(F.coalesce(F.sum("bytes_"), F.lit(0)).alias("n")).first()["n"]
    result = [c for c in rest] + ["bytes_", "shard", "depth", "total"]
    if whole <= limit:
        out = rows.withColumns({"shard": F.lit(""), "depth": F.lit(0), "total": F.lit(whole).cast("long")}).select(*result)
        return _named(out, rest)
    done: DataFrame | None = None
    for used in range(0, 2 * BITS, step):
        key = F.col("h1") if used < BITS else F.col("h2")
        cell = F.shiftright(key, BITS - used % BITS - step).bitwiseAND((1 << step) - 1)
        leaves = checkpointed(_leaves(rows, limit, step, used))
        here = rows.withColumn("cell", cell).join(leaves.withColumnRenamed("depth", "more"), ["parent", "cell"])
        bits = F.lpad(F.bin("cell"), step, "0")
        found = here.where(F.col("more").isNotNull())
        found = found.withColumns({"shard": F.concat("parent", F.expr(f"substring(lpad(bin(cell), {step}, '0'), 1, more)")), "depth": F.col("more") + used}).select(*result)
        done = found if done is None else done.unionByName(found)
        if leaves.where(F.col("depth").isNull()).limit(1).count() == 0:
            return _named(done, rest)
        rows = checkpointed(here.where(F.col("more").isNull()).withColumn("parent", F.concat("parent", bits)).drop("cell", "more", "total"))
    return _named(done.unionByName(_overflow(rows, limit).select(*result)), rest)


def directory(shards: DataFrame) -> DataFrame:
    """The directory of rows placed by extendible_shards: shard, depth, global_depth (the most bits that any bucket uses) and the slots that point to the bucket.

    Slots are indexed by the first global_depth bits. A bucket of fewer bits has 2**(global_depth - depth) neighbouring ones, given by the first and the last, as bits: so the
    directory has a row for each bucket and not for each slot. Pages of an overflowing bucket share its slot. Halves of split buckets that hold no row are buckets too, so all slots
    point somewhere.
    """
    buckets = shards.select("shard", "depth", F.substring_index("shard", "/", 1).alias("bits")).distinct()
    path = buckets.select(F.explode(F.transform(F.sequence(F.lit(0), F.length("bits")), lambda k: F.substring(F.col("bits"), F.lit(1), k))).alias("bits")).distinct()
    other = F.concat(F.expr("left(bits, length(bits) - 1)"), F.translate(F.right("bits", F.lit(1)), "01", "10"))
    empty = path.where("bits <> ''").select(other.alias("bits")).join(path, "bits", "left_anti").select(F.col("bits").alias("shard"), F.length("bits").alias("depth"), "bits")
    every = buckets.unionByName(empty)
    deepest = every.agg(F.max("depth").alias("global_depth"))
    filled = lambda c: F.rpad("bits", F.col("global_depth"), c)
    return every.crossJoin(deepest).select("shard", "depth", "global_depth", filled("0").alias("first_slot"), filled("1").alias("last_slot"))  # a one-row side


def slot_bits(id_col: str, text_col: str) -> Column:
    """All bits that a directory may index by, as a string: a row belongs to the bucket whose slots its first bits lie between."""
    both = hash_bits(F.coalesce(F.col(id_col).cast("string"), F.lit("null"))), hash_bits(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    return F.concat(*[F.lpad(F.bin(h), BITS, "0") for h in both])


def _overflow(rows: DataFrame, limit: int) -> DataFrame:
    """Equal rows in pages that fit: a row's number is the rows of its hash in the partitions before it plus its number in its own."""
    key = ["parent", "h2"]
    counts = rows.groupBy(*key, "pid").count()
    before = F.coalesce(F.sum("count").over(Window.partitionBy(*key).orderBy("pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = rows.withColumn("own", F.row_number().over(Window.partitionBy(*key, "pid").orderBy("bytes_")))
    placed = numbered.join(counts.withColumn("before", before), [*key, "pid"])
    a_page = F.greatest(F.lit(1), F.floor(F.lit(limit) / F.greatest("bytes_", F.lit(1)))).cast("long")
    page = F.floor((F.col("before") + F.col("own") - 1) / a_page)
    all_of = F.sum("count").over(Window.partitionBy(*key))
    total = F.least(a_page, F.col("all") - page * a_page) * F.col("bytes_")
    placed = placed.join(counts.select(*key, all_of.alias("all")).distinct(), key)
    return placed.withColumns({"shard": F.concat("parent", F.lit("/"), page.cast("string")), "depth": F.lit(2 * BITS), "total": total.cast("long")})


def _named(out: DataFrame, rest: list[str]) -> DataFrame:
    return out.select(*rest, F.col("bytes_").alias("n_bytes"), "shard", F.col("depth").cast("int").alias("depth"), F.col("total").alias("shard_bytes"))
