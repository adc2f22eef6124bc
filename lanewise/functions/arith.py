"""Elementwise addition, subtraction and multiplication: wrapping, checked and saturating.

Integers up to 32 bits go through BIGINT. BIGINT itself is added by halves and multiplied by limbs, with overflow read off the
signs; only products that may overflow and u64 go through exact decimals. Null operands give null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .kinds import ARITH_OPS, I64, U32, U64, Kind, as_column, exact
from .wide import add64, from_pattern, mul64, sub64, to_pattern


def _checked_op(op: str) -> None:
    if op not in ARITH_OPS:
        raise ValueError(f"unknown operation {op!r}")


def _plain(op: str, a: Column, b: Column) -> Column:
    return {"add": lambda: a + b, "sub": lambda: a - b, "mul": lambda: a * b}[op]()


def _decimal(op: str, a: Column, b: Column) -> Column:
    kind = "decimal(38,0)" if op == "mul" else "decimal(22,0)"
    return _plain(op, a.cast("decimal(20,0)"), b.cast("decimal(20,0)")).cast(kind)


def _narrow(op: str, kind: Kind) -> bool:
    """Whether a BIGINT holds the exact result."""
    return kind.bits < 32 or (kind.bits == 32 and not (kind is U32 and op == "mul"))


def wrapping(op: str, a: Column, b: Column | int | float, kind: Kind) -> Column:
    """``a op b``; integers wrap at the type's width, floats follow IEEE 754."""
    _checked_op(op)
    b = as_column(b, kind)
    if kind.floating:
        return _plain(op, a, b).cast(kind.spark)
    if _narrow(op, kind):
        least, span = kind.least, 1 << kind.bits
        exact_result = _plain(op, a.cast("bigint"), b.cast("bigint"))
        return (F.pmod(exact_result - F.lit(least).cast("bigint"), F.lit(span).cast("bigint")) + F.lit(least).cast("bigint")).cast(kind.spark)
    if kind is U32:
        return mul64(a, b).bitwiseAND(F.lit((1 << 32) - 1)).cast(kind.spark)
    step = {"add": add64, "sub": sub64, "mul": mul64}[op]
    if kind is I64:
        return step(a, b)
    return from_pattern(step(to_pattern(a), to_pattern(b)))


def overflows(op: str, a: Column, b: Column | int, kind: Kind) -> Column:
    """Whether the exact result lies outside of the type. Integers only."""
    _checked_op(op)
    if kind.floating:
        raise ValueError("overflow is defined for integers")
    b = as_column(b, kind)
    if _narrow(op, kind):
        return ~_plain(op, a.cast("bigint"), b.cast("bigint")).between(F.lit(kind.least).cast("bigint"), F.lit(kind.greatest).cast("bigint"))
    if kind is I64 and op == "add":
        total = add64(a, b)
        return a.bitwiseXOR(total).bitwiseAND(b.bitwiseXOR(total)) < 0
    if kind is I64 and op == "sub":
        return a.bitwiseXOR(b).bitwiseAND(a.bitwiseXOR(sub64(a, b))) < 0
    if kind is U64 and op == "mul":
        # 128 bits don't fit a decimal: the upper half of b alone, then the whole in parts.
        wide_a, half = a.cast("decimal(20,0)"), exact(1 << 32)
        lower = F.pmod(b.cast("decimal(20,0)"), half.cast("decimal(20,0)"))
        upper = ((b.cast("decimal(20,0)") - lower) / half).cast("decimal(10,0)")
        with_upper = (wide_a * upper).cast("decimal(38,0)")
        rest = (with_upper.cast("decimal(20,0)") * half.cast("decimal(11,0)")).cast("decimal(38,0)") + (wide_a * lower.cast("decimal(10,0)")).cast("decimal(38,0)")
        return F.when(with_upper >= half, F.lit(True)).otherwise(F.when(with_upper < half, rest >= exact(1 << 64)))
    return ~_decimal(op, a, b).between(exact(kind.least), exact(kind.greatest))


def checked(op: str, a: Column, b: Column | int, kind: Kind) -> Column:
    """A struct of the wrapped ``value`` and whether it ``overflowed``; null for a null operand."""
    b = as_column(b, kind)
    return F.when(a.isNotNull() & b.isNotNull(), F.struct(wrapping(op, a, b, kind).alias("value"), overflows(op, a, b, kind).alias("overflowed")))


def saturating(op: str, a: Column, b: Column | int, kind: Kind) -> Column:
    """``a op b``, or the end of the type's range on the side that the exact result exceeds."""
    over = overflows(op, a, b, kind)
    b = as_column(b, kind)
    if op == "mul":
        falls = (a < 0) != (b < 0)
    elif op == "add":
        falls = (b < 0) if kind.signed else F.lit(False)
    else:
        falls = b > 0
    end = F.when(falls, kind.lit(kind.least)).otherwise(kind.lit(kind.greatest))
    return F.when(over, end).otherwise(wrapping(op, a, b, kind))
