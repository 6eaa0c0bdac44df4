"""URL filters: a sort-merge range join of urls with host and path rules.

A host is written as its labels in reverse order, each followed by a dot: `m.example.net` is `net.example.m.`. All hosts under a rule's host then form the
interval [`net.example.`, `net.example/`), since `/` follows `.` and occurs in no host. The intervals are nested or disjoint. One sorted sweep over urls and
interval ends keeps the stack of rules that are active: each interval end carries the stack that holds after it, and a url reads the last one before it.

Any subset of the urls can be swept with all rules, so the urls are dealt by a hash of their rows into `lanes` sweeps (default: four for each shuffle partition) and the rules'
ends are repeated in each. A host with a third of all pages is spread evenly, and no url is grouped with others by key. The stacks themselves come from equi-joins of each rule with its
ancestors. All of it is built-in expressions.

Equal rows meet in one sweep, which sorts them with spilling.

Defined cases: a null url, or one without `://`, has an empty host and path and gets no rule; repeated rows are kept; a rule's host matches itself and all its
subdomains; among the rules that fit, the longest host wins, then the longest path, then the larger text; urls of any length are read whole; without a rule the verdict is `default`;
columns with the result's names are replaced; empty tables work on either side.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framequarry.llm._common import ascii_lower, let

#: The rules of the contract.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))


def rule_table(spark: SparkSession, rules: Iterable[tuple[str, str, str]] = RULES) -> DataFrame:
    """The rules as a table of literals."""
    quoted = lambda x: "NULL" if x is None else "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"
    rows = ", ".join(f"({', '.join(map(quoted, r))})" for r in rules)
    return spark.sql(f"SELECT * FROM VALUES {rows or '(NULL, NULL, NULL)'} AS t(host, path, verdict)").select(*[F.col(c).cast("string").alias(c) for c in ("host", "path", "verdict")])


def url_host(url: Column) -> Column:
    return let(
        F.coalesce(url, F.lit("")),
        lambda u: F.when(F.locate("://", u) == 0, F.lit("")).otherwise(
            ascii_lower(_until(F.substring(u, F.locate("://", u) + 3, 2**31 - 1), "/?#"))
        ),
    )


def _until(text: Column, ends: str) -> Column:
    for c in ends:
        text = F.substring_index(text, c, 1)
    return text


def url_path(url: Column) -> Column:
    def of(u: Column) -> Column:
        rest = _until(F.substring(u, F.locate("://", u) + 3, 2**31 - 1), "?#")
        return let(rest, lambda r: F.when(F.locate("/", r) == 0, F.lit("")).otherwise(F.substring(r, F.locate("/", r), 2**31 - 1)))

    return let(F.coalesce(url, F.lit("")), lambda u: F.when(F.locate("://", u) == 0, F.lit("")).otherwise(of(u)))


def host_key(host: Column) -> Column:
    """Labels in reverse order, each followed by a dot."""
    return F.concat(F.concat_ws(".", F.reverse(F.split(host, r"\."))), F.lit("."))


def _stacks(rules: DataFrame) -> DataFrame:
    """Per rule host: key, and the stack of rules that are active inside its interval: its own and those of its ancestors, winners first."""
    rule = F.struct(F.length("host").alias("hl"), F.length("path").alias("pl"), "host", "path", "verdict")
    own = rules.where(F.col("host").isNotNull() & F.col("path").isNotNull()).select(ascii_lower(F.col("host")).alias("host"), "path", "verdict").distinct()
    by_host = own.groupBy("host").agg(F.collect_set(rule).alias("rules"))
    chain = by_host.select(F.col("host").alias("at"), F.split("host", r"\.").alias("labels")).select(
        "at", F.explode(F.transform(F.sequence(F.lit(1), F.size("labels")), lambda i: F.concat_ws(".", F.slice("labels", i, F.size("labels"))))).alias("host")
    )
    ordered = F.sort_array(F.flatten(F.collect_list("rules")), asc=False)
    return chain.join(by_host, "host").groupBy("at").agg(ordered.alias("stack")).select(F.col("at").alias("host"), host_key(F.col("at")).alias("key"), "stack")


def _events(stacks: DataFrame) -> DataFrame:
    """Two rows per rule host: its stack where the interval begins, and the next outer stack where it ends."""
    outer = stacks.select(
        "key",
        "host",
        "stack",
        F.filter("stack", lambda r: r["host"] != F.col("host")).alias("outer"),
    )
    begin = outer.select(F.col("key").alias("k"), F.length("key").alias("step"), F.col("stack"))
    # intervals that end at the same key would be ordered inner first; such keys differ here, as each ends with its own last label
    end = outer.select(F.concat(F.expr("substring(key, 1, length(key) - 1)"), F.lit("/")).alias("k"), (-F.length("key")).alias("step"), F.col("outer").alias("stack"))
    return begin.unionByName(end)


def filter_urls(urls: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow", lanes: int | None = None) -> DataFrame:
    """urls with host, path, rule and verdict as further columns."""
    lanes = lanes or 4 * int(urls.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keep = [c for c in urls.columns if c not in {"host", "path", "rule", "verdict"}]
    rows = F.struct(*[F.col(c) for c in keep]) if keep else F.struct(F.lit(0).alias("_none"))
    # by a hash of the row, so a task that is run again deals its rows as before
    whole = [F.col(c) for c, t in urls.dtypes if not any(k in t for k in ("map<", "variant", "interval"))]
    lane = F.pmod(F.xxhash64(*whole), F.lit(lanes)).cast("int").alias("lane")
    base = urls.select(lane, rows.alias("row"), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"))
    pages = base.select(
        "lane",
        host_key(F.col("host")).alias("k"),
        F.lit(2**30).alias("step"),
        F.lit(None).cast("array<struct<hl:int,pl:int,host:string,path:string,verdict:string>>").alias("stack"),
        "row",
        "host",
        "path",
    )
    ends = _events(_stacks(rules)).select(
        F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))).alias("lane"),
        "k",
        "step",
        "stack",
        F.lit(None).cast(pages.schema["row"].dataType).alias("row"),
        F.lit(None).cast("string").alias("host"),
        F.lit(None).cast("string").alias("path"),
    )
    sweep = Window.partitionBy("lane").orderBy("k", "step").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    active = pages.unionByName(ends).withColumn("active", F.last("stack", ignorenulls=True).over(sweep)).where(F.col("row").isNotNull())
    won = F.get(F.filter("active", lambda r: F.startswith(F.col("path"), r["path"])), F.lit(0))
    out = active.select("row", "host", "path", won.alias("won"))
    return out.select(
        *[F.col("row")[c].alias(c) for c in keep],
        "host",
        "path",
        F.concat(F.col("won")["host"], F.col("won")["path"]).alias("rule"),
        F.coalesce(F.col("won")["verdict"], F.lit(default)).alias("verdict"),
    )
