"""Quality rules: a threshold table compiled into one Spark projection.

Every figure is a built-in expression on one row, so a table is judged in a single pass without a shuffle, a Python worker or a second read of the text.
Hot sources and groups of copies make no difference, as no row meets another.

Figures of whole words and lines come from generated code; only what looks at each word (windows, stop words) is an array function, made once for each row.

Defined cases: a null text counts as an empty one (no words, so it is rejected); a null id stays null; texts of any length are read whole, runs of blanks or symbols
included; repeated rows are judged each on its own, ties at a threshold pass; columns with the names of the figures are replaced; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framequarry.llm._common import let, word_array

#: Frequent short words of English, German, French and Spanish.
STOP_WORDS = tuple("the of and to in is on for that with der die das und in zu den mit von ist le la les de des et en un une pour el los las del que y por con para es".split())
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """A document passes if low <= figure <= high (None: no bound). The figure is numerator / denominator, or the numerator alone."""

    name: str
    numerator: str
    denominator: str | None
    low: float | None
    high: float | None


#: The two base rules of the contract, as thresholds on the figures below.
BASE_RULES = (
    Rule("too_few_words", "n_words", None, 50, None),
    Rule("repeated_windows", "n_repeat_words", "n_words", None, 0.5),
)
#: The method's own rules. They are wide on purpose, but the stop words are of four languages: a clean text of another language, or a word list or table, may fail stop_word_ratio.
RULES = (
    Rule("mean_word_length", "word_chars", "n_words", 2, 20),
    Rule("symbol_ratio", "n_symbols", "n_words", None, 0.3),
    Rule("stop_word_ratio", "n_stop_words", "n_words", 0.005, None),
    Rule("duplicate_line_ratio", "n_dup_lines", "n_lines", None, 0.5),
)


#: Matches each line that holds a word, whole. Anchored at line starts and possessive, so blank runs of any length are read once.
_FULL_LINES = r"(?md)^[\x20\x09\x0B-\x0D]*+[^\x20\x09-\x0D][^\n]*+"


def _repeat_words(words: Column) -> Column:
    """Words that lie in 3-word windows found twice or more; windows are compared by XXH64 within their text.

    A set of the hashes tells texts without any repeat. In the others, numbers of the hash's high bits and the window's start are sorted, as plain longs; windows whose
    high bits meet are compared by whole hashes, so the cut bits lose nothing. The union of the found windows is summed from the gaps between their starts.
    """
    last = F.greatest(F.size(words) - 2, F.lit(0))
    hashes = F.slice(F.transform(words, lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2))), 1, last)

    def with_equal_neighbour(x: Column, same: Callable[[Column, Column], Column]) -> Column:
        beside = lambda v, j: F.coalesce(same(v, F.get(x, j)), F.lit(False))
        return F.filter(x, lambda v, j: beside(v, j - 1) | beside(v, j + 1))

    def repeated(h: Column) -> Column:
        low = F.pow(F.lit(2), F.length(F.bin(F.size(h)))).cast("long") - 1
        return let(low, lambda low: let(F.bitwise_not(low), lambda high: by_bits(h, low, high)))

    def by_bits(h: Column, low: Column, high: Column) -> Column:
        keyed = F.sort_array(F.transform(h, lambda x, i: x.bitwiseAND(high).bitwiseOR(i.cast("long"))))
        near = let(keyed, lambda k: with_equal_neighbour(k, lambda x, y: x.bitwiseXOR(y).bitwiseAND(high) == 0))
        at = F.transform(near, lambda x: x.bitwiseAND(low).cast("int"))
        pairs = F.sort_array(F.transform(at, lambda i: F.struct(F.get(h, i).alias("h"), i.alias("i"))))
        found = let(pairs, lambda k: with_equal_neighbour(k, lambda x, y: x["h"] == y["h"]))
        return let(F.sort_array(F.transform(found, lambda x: x["i"])), covered)

    def covered(starts: Column) -> Column:
        gaps = F.transform(starts, lambda x, j: F.when(j == 0, 3).otherwise(F.least(F.lit(3), x - F.get(starts, j - 1))))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, x: a + x)

    none = F.lit(0).cast("long")
    return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), none).otherwise(repeated(h)))


def _any_case(words: Iterable[str]) -> list[str]:
    """The words in all ways of writing their letters, for a look-up without lower-casing texts."""
    return sorted({"".join(x) for w in words for x in product(*((c, c.upper()) for c in w))})


def _once(df: DataFrame, **columns: Column) -> DataFrame:
    """df with columns that are made once for each row: a generated row of its own, which the optimizer neither copies into its uses nor moves filters through."""
    return df.select(*df.columns, F.inline(F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))))


def _with_plain_figures(df: DataFrame, text_col: str) -> DataFrame:
    """df with the figures that need no windows, and the words as _w. All of it runs in generated code."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    parts = _once(df, _w=word_array(text), _l=F.regexp_extract_all(text, F.lit(_FULL_LINES), F.lit(0)))
    long = lambda c: c.cast("long")
    out = _once(
        parts,
        n_words=long(F.size("_w")),
        word_chars=long(F.length(F.array_join("_w", ""))),
        n_symbols=long(F.regexp_count(text, F.lit(f"[{SYMBOLS}]"))),
        n_lines=long(F.size("_l")),
        n_dup_lines=long(F.size("_l") - F.size(F.array_distinct("_l"))),
    )
    return out.drop("_l")


def _with_window_figures(df: DataFrame) -> DataFrame:
    """df with the figures that look at each word of _w."""
    stops = _any_case(STOP_WORDS)
    return _once(df, n_repeat_words=_repeat_words(F.col("_w")), n_stop_words=F.size(F.filter("_w", lambda w: w.isin(*stops))).cast("long")).drop("_w")


def failed(rules: Iterable[Rule]) -> Column:
    """The table of thresholds as one boolean expression over the figures' columns: true if a rule is broken. Ratios are compared by multiplication, so no division by zero arises."""
    out = F.lit(False)
    for r in rules:
        value = F.col(r.numerator)
        per = F.col(r.denominator) if r.denominator else F.lit(1)
        if r.low is not None:
            out = out | (value < F.lit(r.low) * per)
        if r.high is not None:
            out = out | (value > F.lit(r.high) * per)
    return out


PLAIN = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines")
FIGURES = (*PLAIN, "n_repeat_words", "n_stop_words")
_OWN = {*FIGURES, "base_failed", "kept", "_w", "_l"}


def quality_rules(df: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES, base: tuple[Rule, ...] = BASE_RULES) -> DataFrame:
    """df with the figures, base_failed and kept as further columns."""
    rest = df.select(*[c for c in df.columns if c not in _OWN - {text_col}])
    out = _with_window_figures(_with_plain_figures(rest, text_col))
    return out.select("*", failed(base).alias("base_failed"), (~failed(base) & ~failed(rules)).alias("kept"))


def passing_documents(df: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES, base: tuple[Rule, ...] = BASE_RULES) -> DataFrame:
    """The rows of df that pass all rules, with df's columns as they were. Rules on plain figures come first, so a text that they reject is not looked at further."""
    given = df.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(df.columns)])
    every = [*base, *rules]
    plain = [r for r in every if {r.numerator, r.denominator} <= {*PLAIN, None}]
    some = _with_plain_figures(given, f"c{df.columns.index(text_col)}").where(~failed(plain))
    kept = _with_window_figures(some).where(~failed([r for r in every if r not in plain]))
    return kept.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(df.columns)])
