"""Compression parameters and frame plans: levels, strategies, job splits, long-distance matching, length codes."""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framequarry.functions.bytes import first_true, high_bit, in_steps
from framequarry.functions.frames import BLOCK_MAX, WINDOW_LOG_MAX, compress_bound, written_header_size

# Fixed values.
STRATEGIES = ("fast", "dfast", "greedy", "lazy", "lazy2", "btlazy2", "btopt", "btultra", "btultra2")
STRATEGY_BOUNDS = (1, 3, 5, 7, 9, 12, 15, 18)
LEVEL_MIN, LEVEL_MAX, LEVEL_DEFAULT = -131072, 22, 3
SIZE_CLASSES = (256 << 10, 128 << 10, 16 << 10)
LDM_WINDOW_LOG = 20
HISTORY_MAX = 64 << 20
JOB_MIN, JOBS_PER_WORKER = 512 << 10, 2
LL_BASE = (0, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15, 16, 18, 20, 22, 24, 28, 32, 40, 48, 64, 128, 256, 512, 1024, 2048, 4096, 8192, 16384, 32768, 65536)
ML_BASE = (
    *range(3, 35),
    35, 37, 39, 41, 43, 47, 51, 59, 67, 83, 99, 131, 259, 515, 1027, 2051, 4099, 8195, 16387, 32771, 65539,
)


@cache
def level_table() -> tuple[tuple[int, ...], ...]:
    """(size class, row, window, chain, hash and search log, least match, target length, strategy), as the installed codec library gives them."""
    import zstandard

    rows = []
    for k, size in enumerate((1 << 30, *SIZE_CLASSES)):
        for row in range(LEVEL_MAX + 1):
            p = zstandard.ZstdCompressionParameters.from_level(row or -1, source_size=size)
            rows.append((k, row, p.window_log, p.chain_log, p.hash_log, p.search_log, p.min_match, p.target_length if row else 1, p.strategy))
    return tuple(rows)


def level_parameters(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        list(level_table()), "size_class int, row int, window_log int, chain_log int, hash_log int, search_log int, min_match int, target_length int, strategy int"
    )


def size_class(n: Column) -> Column:
    """0 above 256 KiB, 1 to 3 for at most 256, 128 and 16 KiB."""
    return first_true((n <= SIZE_CLASSES[2], F.lit(3)), (n <= SIZE_CLASSES[1], F.lit(2)), (n <= SIZE_CLASSES[0], F.lit(1)), default=F.lit(0))


def level_row(level: Column) -> Column:
    """Level 0 is the default, negative ones share row 0, high ones the last."""
    return F.when(level == 0, LEVEL_DEFAULT).when(level < 0, 0).otherwise(F.least(level, F.lit(LEVEL_MAX)))


def with_level_parameters(df: DataFrame, level: str, size: str) -> DataFrame:
    """df with the parameters of its level and size, by a join with the 92-row table. Negative levels give their distance from 0 as target length; windows shrink to the size."""
    table = F.broadcast(level_parameters(df.sparkSession))  # 92 rows
    keyed = df.withColumns({"size_class": size_class(F.col(size)), "row": level_row(F.col(level))})
    joined = keyed.join(table, ["size_class", "row"])
    fit = F.greatest(F.lit(10), F.when(F.col(size) <= 1, 0).otherwise(high_bit(F.col(size) - 1) + 1))
    return joined.withColumns(
        {
            "window_log": F.least("window_log", F.when(F.col(size) > 0, fit).otherwise(F.col("window_log"))),
            "target_length": F.when(F.col(level) < 0, -F.col(level)).otherwise(F.col("target_length")),
            "strategy": F.element_at(F.array(*[F.lit(s) for s in STRATEGIES]), F.col("strategy")),
        }
    )


def strategy_from_level(level: Column) -> Column:
    return first_true(*[(level <= b, F.lit(s)) for b, s in zip(STRATEGY_BOUNDS, STRATEGIES, strict=False)], default=F.lit(STRATEGIES[-1]))


def overlap_log(strategy: Column) -> Column:
    return F.when(strategy == "btultra2", 9).when(strategy.isin("btultra", "btopt"), 8).when(strategy.isin("btlazy2", "lazy2"), 7).otherwise(6)


def search_settings(strategy: Column) -> Column:
    """struct<finder, lazy_steps> of a strategy: which structure finds matches, and how many steps the parser looks ahead."""
    finder = F.when(strategy.isin("fast", "dfast"), "hash_table").when(strategy.isin("greedy", "lazy", "lazy2"), "hash_chain").otherwise("binary_tree")
    steps = F.when(strategy.isin("fast", "dfast", "greedy"), 0).when(strategy == "lazy", 1).otherwise(2)
    return F.struct(finder.alias("finder"), steps.alias("lazy_steps"))


def _two_to(k: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), k.cast("int"))


def with_frame_plan(df: DataFrame, n: Column, window_log: Column, ldm: Column, dict_id: Column, name: str = "plan") -> DataFrame:
    """df with what a frame of n bytes declares: struct<single_segment, window_size, dict_id, history_limit, search_window>. window_log 0: from the size."""
    c = F.col
    return in_steps(
        df,
        name,
        {"fp_n": n.cast("bigint"), "fp_ldm": ldm},
        {"fp_declared": F.when(window_log != 0, _two_to(window_log)).otherwise(F.greatest("fp_n", F.lit(1024)))},
        {"fp_single": (c("fp_declared") >= c("fp_n")) & (c("fp_n") < 256 * 1024)},
        {"fp_window": F.greatest(c("fp_declared"), F.when(c("fp_single"), 1024).when(c("fp_ldm"), 1 << LDM_WINDOW_LOG).otherwise(0)).cast("bigint")},
        {"fp_log": F.least(F.lit(WINDOW_LOG_MAX), high_bit(c("fp_window")))},
        {
            "single_segment": c("fp_single"),
            "window_size": c("fp_window"),
            "dict_id": dict_id.cast("bigint"),
            "history_limit": F.least(_two_to(c("fp_log")), F.lit(HISTORY_MAX)).cast("bigint"),
            "search_window": F.when(c("fp_window") < 1024, F.lit(1024).cast("bigint")).when(c("fp_log") < 31, _two_to(c("fp_log"))).otherwise(F.lit(2**32 - 1)),
        },
    )


def with_job_split(
    df: DataFrame, n: Column, threads: Column, strategy: Column, plan: str, ldm: Column, name: str = "split", job_min: int = JOB_MIN
) -> DataFrame:
    """df with how n bytes are divided among parallel jobs, and the room their frame can need: struct<num_jobs, job_size, overlap, needed>. plan: a column of with_frame_plan.

    There are two jobs for each thread at most, none smaller than job_min. A job sees an overlap of the bytes before its own: a share of the history that the strategy sets. Jobs are
    at least as long as their overlap, which may leave fewer of them.
    """
    c = F.col
    up = lambda a, b: F.floor((a + b - 1) / b).cast("bigint")
    share = F.greatest(c("js_log") - (9 - overlap_log(strategy)), F.lit(0))
    with_ldm = F.greatest(F.least(c("js_log"), F.greatest(high_bit(c("js_even")) - 2, F.lit(0))) - (9 - overlap_log(strategy)), F.lit(0))
    return in_steps(
        df,
        name,
        {"js_n": n.cast("bigint"), "js_log": high_bit(c(plan)["history_limit"]), "js_most": F.greatest(threads, F.lit(1)) * JOBS_PER_WORKER},
        {"js_wanted": F.least(F.greatest(up(c("js_n"), F.lit(max(job_min, 1))), F.lit(1)), c("js_most"), F.greatest("js_n", F.lit(1))).cast("bigint")},
        {"js_even": F.when(c("js_wanted") <= 1, c("js_n")).otherwise(up(c("js_n"), c("js_wanted")))},
        {"js_overlap": F.when(c("js_wanted") > 1, _two_to(F.least(F.when(ldm, with_ldm).otherwise(share), c("js_log")))).otherwise(0).cast("bigint")},
        {
            "js_size": F.when(c("js_wanted") > 1, F.greatest("js_even", "js_overlap")).otherwise(c("js_n")),
            "js_jobs": F.when((c("js_wanted") > 1) & (c("js_even") < c("js_overlap")), up(c("js_n"), c("js_overlap"))).otherwise(c("js_wanted")).cast("bigint"),
        },
        {
            "num_jobs": c("js_jobs"),
            "job_size": c("js_size"),
            "overlap": c("js_overlap"),
            "needed": written_header_size(c("js_n"), c(plan)["dict_id"], c(plan)["single_segment"])
            + (c("js_jobs") - 1) * compress_bound(c("js_size"))
            + compress_bound(c("js_n") - (c("js_jobs") - 1) * c("js_size"))
            + 4,
        },
    )


def adjust_ldm(window_log: Column, strategy_no: Column, hash_log: Column) -> Column:
    """struct<hash_rate_log, hash_log, min_match, bucket_size_log>: long-distance settings left at zero, from a window, strategy (1 to 9) and hash log."""
    rate = F.when(hash_log > 0, F.greatest(window_log - hash_log, F.lit(0))).otherwise(7 - F.floor(strategy_no / 3))
    table = F.when(window_log <= rate, 6).otherwise(F.greatest(F.lit(6), F.least(F.lit(30), window_log - rate)))
    bucket = F.least(F.greatest(F.lit(4), F.least(F.lit(8), strategy_no)), table)
    return F.struct(
        F.greatest(rate, F.lit(1)).cast("int").alias("hash_rate_log"),
        table.cast("int").alias("hash_log"),
        F.when(strategy_no >= 8, 32).otherwise(64).alias("min_match"),
        bucket.cast("int").alias("bucket_size_log"),
    )


def ldm_table_size(hash_log: Column, bucket_size_log: Column) -> Column:
    """Bytes of the table: 8 an entry, and one for each bucket."""
    return _two_to(hash_log) * 8 + _two_to(hash_log - F.least(bucket_size_log, hash_log))


def _code(value: Column, bases: tuple[int, ...]) -> Column:
    """The index of the greatest base that is at most the value."""
    return F.size(F.filter(F.array(*[F.lit(b) for b in bases]), lambda b: b <= value)) - 1


def literal_length_code(n: Column) -> Column:
    return _code(n, LL_BASE)


def match_length_code(n: Column) -> Column:
    return _code(n, ML_BASE)


def offset_code(distance: Column) -> Column:
    """Null below 4: such distances are only written as repeats."""
    return F.when(distance >= 4, high_bit(distance + 3))


def window_limit(window_log: Column) -> Column:
    """The largest distance; none for 0 and from 31 on."""
    return F.when((window_log > 0) & (window_log < 31), _two_to(window_log))


def block_count(n: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(n / F.lit(BLOCK_MAX))).cast("bigint")
