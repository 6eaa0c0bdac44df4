"""Little-endian numbers and bit scans as built-in expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _col(x: Column | str | int) -> Column:
    return F.lit(x) if isinstance(x, int) else F.col(x) if isinstance(x, str) else x


def materialized(df: DataFrame, name: str) -> DataFrame:
    """df with a column as a row value of its own: made once, and neither copied into the expressions that use it nor into filters that would move below it."""
    rest = [c for c in df.columns if c != name]
    return df.select(*rest, F.inline(F.array(F.struct(F.col(name).alias(name))))).select(*df.columns)


def in_steps(df: DataFrame, name: str, *steps: dict[str, Column]) -> DataFrame:
    """df with the struct of the last step's columns. Each step is a projection over the columns of those before it, so what is used often is made once, in generated code, and no expression grows long."""
    out = df
    for step in steps[:-1]:
        out = out.withColumns(step)
    return out.withColumn(name, F.struct(*[c.alias(k) for k, c in steps[-1].items()])).select(*[c for c in df.columns if c != name], name)


def part(b: Column, offset: Column | int, n: Column | int) -> Column:
    """n bytes from a 0-based offset; fewer if the buffer ends."""
    return F.substring(b, _col(offset).cast("int") + 1, _col(n).cast("int"))


def latin(b: Column) -> Column:
    """Each byte as the character of its number, for byte_of."""
    return F.decode(b, "ISO-8859-1")


def byte_of(chars: Column, at: Column | int) -> Column:
    """The number of a character of latin text, as a bigint; 0 beyond its end."""
    return F.ascii(F.substring(chars, _col(at).cast("int") + 1, F.lit(1))).cast("bigint")


def number_of(chars: Column, at: Column | int, n: int) -> Column:
    """The little-endian number of n characters of latin text: bigint up to 7 bytes, decimal(20,0) for 8."""
    at = _col(at)
    value = reduce(Column.bitwiseOR, [F.shiftleft(byte_of(chars, at + i), 8 * i) for i in range(min(n, 7))])
    return value if n < 8 else byte_of(chars, at + 7).cast("decimal(20,0)") * F.lit(1 << 56).cast("decimal(20,0)") + value.cast("decimal(20,0)")


def read_le(b: Column, offset: Column | int, n: int) -> Column:
    """An unsigned number of n bytes: bigint up to 7 bytes, decimal(20,0) for 8. Null if the buffer is too short."""
    offset = _col(offset)
    value = number_of(latin(part(b, offset, n)), 0, n).cast("bigint" if n < 8 else "decimal(20,0)")
    return F.when(F.octet_length(b) >= offset + n, value)


def write_le(value: Column, n: int) -> Column:
    """The low n bytes of a bigint."""
    value = value.cast("bigint")
    return F.encode(F.concat(*[F.char(F.shiftright(value, 8 * i).bitwiseAND(255)) for i in range(n)]), "ISO-8859-1")


def byte_at(b: Column, offset: Column | int) -> Column:
    return read_le(b, offset, 1)


def high_bit(value: Column, bits: int = 63) -> Column:
    """The position of the highest set bit of a positive bigint; null below 1. Without floating point."""
    value = value.cast("bigint")
    return F.when(value > 0, F.length(F.bin(value)) - 1)


def trailing_zeros(value: Column) -> Column:
    value = value.cast("bigint")
    return F.when(value != 0, F.bit_count(value.bitwiseAND(-value) - 1))


def leading_zeros32(value: Column) -> Column:
    return F.when(value.cast("bigint") == 0, F.lit(32)).otherwise(31 - high_bit(value.bitwiseAND(0xFFFFFFFF)))


def rotate_left32(value: Column, n: int) -> Column:
    v = value.cast("bigint").bitwiseAND(0xFFFFFFFF)
    return F.shiftleft(v, n % 32).bitwiseOR(F.shiftright(v, (32 - n) % 32)).bitwiseAND(0xFFFFFFFF) if n % 32 else v


def rotate_right32(value: Column, n: int) -> Column:
    return rotate_left32(value, -n % 32)


def rotate_left64(value: Column, n: int) -> Column:
    v = value.cast("bigint")
    return F.shiftleft(v, n % 64).bitwiseOR(F.shiftrightunsigned(v, 64 - n % 64)) if n % 64 else v


def rotate_right64(value: Column, n: int) -> Column:
    return rotate_left64(value, -n % 64)


def common_bytes(a: Column, b: Column) -> Column:
    """Equal low-order bytes of two different bigints."""
    return F.floor(trailing_zeros(a.cast("bigint").bitwiseXOR(b.cast("bigint"))) / 8).cast("int")


def first_true(*pairs: tuple[Column, Column | None], default: Column | None = None) -> Column:
    """CASE over (condition, value)."""
    out = reduce(lambda acc, p: acc.when(p[0], p[1]), pairs[1:], F.when(*pairs[0]))
    return out.otherwise(default) if default is not None else out
