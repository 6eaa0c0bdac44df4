"""Mixing sources to target weights by hierarchical budgets.

Leaves are (domain, language, source). A leaf can give its tokens `max_epochs` times; a node can give what its leaves can. The budget goes down the tree: at each node
it is shared among the children by weight, a child that can't take its share gets what it can give, and the rest is shared anew among its siblings. As a node
never gets more than its leaves can give, a leaf's shortage goes to its siblings first and to other branches only for what those can't take.
The share has a closed form: with children ordered by capacity per weight, the first k are full, and the others get the same amount per weight.

A leaf with budget b and t tokens gives b div t whole epochs and, of the next one, the longest prefix that fits in the rest, in an order by a seeded hash. The prefix is found by
sums over the hash's first 12 bits; only the one slice in which the prefix ends is sorted, so a leaf with a third of all rows is never gathered.
All of it is built-in expressions; the tree holds one row per leaf, joined by Spark's choice of strategy.

Defined cases: null domains, languages and sources are a leaf value of their own; rows with no tokens (null or empty texts) go with the first whole epoch or the prefix they fall in; null ids are hashed
as "null"; repeated rows are each given; further columns stay; a column `epoch` is replaced; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEVELS = ("domain", "lang", "source")
#: Bits of the order hash that are summed before rows are sorted.
SLICE_BITS = 12


def byte_tokens(text: Column) -> Column:
    """An estimate of a text's tokens: one for four bytes, rounded up."""
    return F.ceil(F.coalesce(F.octet_length(text), F.lit(0)) / 4).cast("long")


def order_hash(seed: int, epoch: Column, doc: Column) -> Column:
    """60 bits by which an epoch is ordered."""
    text = F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def _weight(level: str, weights: Mapping[str, float]) -> Column:
    out = F.lit(1.0)
    for value, w in weights.items():
        out = F.when(F.col(level) == value, F.lit(float(w))).otherwise(out)
    return out


def _shared(children: DataFrame, parents: list[str]) -> DataFrame:
    """Children with weight, capacity and their parent's budget: their own budgets, rounded down."""
    by_fill = Window.partitionBy(*parents).orderBy("fill", *[F.col(c) for c in LEVELS if c in children.columns and c not in parents])
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    rest = by_fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    filled = children.withColumn("fill", F.when(F.col("weight") > 0, F.col("capacity") / F.col("weight")).otherwise(F.lit(float("inf"))))
    level = filled.withColumn("per_weight", (F.col("budget") - F.coalesce(F.sum("capacity").over(before), F.lit(0))) / F.sum("weight").over(rest))
    # the first child that is not full sets the amount per weight of itself and all after it
    opened = F.min(F.when(F.col("per_weight") < F.col("fill"), F.struct("fill", "per_weight"))).over(Window.partitionBy(*parents))
    amount = F.when(opened.isNull() | (F.col("fill") < opened["fill"]), F.col("capacity")).otherwise(F.least(F.col("capacity"), F.floor(F.col("weight") * opened["per_weight"])))
    return level.withColumn("share", amount.cast("long"))


def leaf_budgets(leaves: DataFrame, budget: float, weights: Mapping[str, Mapping[str, float]] | None = None, max_epochs: int = 1) -> DataFrame:
    """Leaves (domain, lang, source, tokens) to the same with `share`, the tokens that each is to give.

    budget: a share of all tokens. weights: for each level the weight of a value among its siblings; 1 where none is named.
    """
    weights = weights or {}
    leaves = leaves.withColumn("capacity", F.col("tokens") * max_epochs)
    top = leaves.agg(F.floor(F.coalesce(F.sum("tokens"), F.lit(0)) * F.lit(budget)).cast("long").alias("budget"), F.coalesce(F.sum("capacity"), F.lit(0)).alias("all"))
    parent = top.select(F.least("budget", "all").alias("budget"), F.lit(0).alias("root"))
    up: list[str] = ["root"]
    for i, level in enumerate(LEVELS):
        keys = ["root", *LEVELS[: i + 1]]
        nodes = leaves.withColumn("root", F.lit(0)).groupBy(*keys).agg(F.sum("capacity").alias("capacity"), F.sum("tokens").alias("tokens"))
        same = [nodes[c].eqNullSafe(F.col(f"p_{c}")) for c in up]
        named = parent.select(F.col("budget"), *[F.col(c).alias(f"p_{c}") for c in up])
        joined = nodes.join(named, same).select(*keys, "capacity", "tokens", "budget")
        children = _shared(joined.withColumn("weight", _weight(level, weights.get(level, {}))), up)
        parent = children.select(*keys, "tokens", F.col("share").alias("budget"))
        up = keys
    return parent.select(*LEVELS, "tokens", F.col("budget").alias("share"))


def mix(
    df: DataFrame, budget: float, weights: Mapping[str, Mapping[str, float]] | None = None, max_epochs: int = 1, seed: int = 7, id_col: str = "doc_id", tokens_col: str = "n_tokens"
) -> DataFrame:
    """The rows of df (with domain, lang and source and a token count), once for each epoch that gives them, with `epoch` from 1."""
    rows = df.drop("epoch")
    tokens = F.coalesce(F.col(tokens_col), F.lit(0)).cast("long")
    leaves = rows.groupBy(*LEVELS).agg(F.sum(tokens).alias("tokens"))
    plan = leaf_budgets(leaves, budget, weights, max_epochs)
    plan = plan.select(
        *[F.col(c).alias(f"p_{c}") for c in LEVELS],
        F.when(F.col("tokens") > 0, F.expr("share div tokens")).otherwise(F.lit(1)).alias("whole_"),
        F.when(F.col("tokens") > 0, F.expr("share % tokens")).otherwise(F.lit(0)).cast("long").alias("rest_"),
    )
    planned = _with_plan(rows, plan, [*LEVELS])
    hashed = planned.withColumns({"hash_": order_hash(seed, F.col("whole_") + 1, F.col(id_col)), "tokens_": tokens})
    hashed = hashed.withColumn("slice_", F.shiftright("hash_", 60 - SLICE_BITS))
    part = hashed.where(F.col("rest_") > 0)
    upto = Window.partitionBy(*LEVELS).orderBy("slice_")
    sums = part.groupBy(*LEVELS, "slice_", "rest_").agg(F.sum("tokens_").alias("sum_")).withColumn("upto_", F.sum("sum_").over(upto))
    cut = sums.where(F.col("upto_") > F.col("rest_")).groupBy(*LEVELS).agg(F.min(F.struct("slice_", (F.col("upto_") - F.col("sum_")).alias("before_"))).alias("c"))
    cut = cut.select(*[F.col(c).alias(f"p_{c}") for c in LEVELS], F.col("c.slice_").alias("cut_"), F.col("c.before_").alias("before_"))
    marked = _with_plan(part, cut, [*LEVELS], "left")
    inside = F.coalesce(F.col("slice_") < F.col("cut_"), F.lit(True))
    in_slice = Window.partitionBy(*LEVELS).orderBy("hash_", id_col, "tokens_").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edge = marked.where(F.col("slice_") == F.col("cut_")).withColumn("run_", F.col("before_") + F.sum("tokens_").over(in_slice)).where(F.col("run_") <= F.col("rest_"))
    next_epoch = (F.col("whole_") + 1).cast("int").alias("epoch")
    whole = planned.where(F.col("whole_") > 0).select(*rows.columns, F.explode(F.sequence(F.lit(1), F.col("whole_").cast("int"))).alias("epoch"))
    return whole.unionByName(marked.where(inside).select(*rows.columns, next_epoch)).unionByName(edge.select(*rows.columns, next_epoch))


def _with_plan(rows: DataFrame, plan: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    same = [rows[c].eqNullSafe(plan[f"p_{c}"]) for c in keys]
    return rows.join(plan, same, how).drop(*[f"p_{c}" for c in keys])
