"""Whole-number arithmetic on 64-bit patterns that wraps instead of raising, whatever the session's ANSI setting.

Partial results stay below 2 ** 63, and shifts drop high bits without an error.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .kinds import exact

LOW32 = 0xFFFFFFFF
TWO_63, TWO_64 = 1 << 63, 1 << 64


def signed(pattern: int) -> int:
    """The signed number with the 64-bit pattern."""
    pattern %= TWO_64
    return pattern - TWO_64 if pattern >= TWO_63 else pattern


def long(pattern: int) -> Column:
    return F.lit(signed(pattern)).cast("bigint")


def low(x: Column) -> Column:
    return x.bitwiseAND(F.lit(LOW32))


def high(x: Column) -> Column:
    return F.shiftrightunsigned(x, 32)


def joined(upper: Column, lower: Column) -> Column:
    return F.shiftleft(upper, 32).bitwiseOR(low(lower))


def add64(a: Column, b: Column) -> Column:
    """a + b modulo 2 ** 64."""
    lower = low(a) + low(b)
    return joined(high(a) + high(b) + high(lower), lower)


def sub64(a: Column, b: Column) -> Column:
    """a - b modulo 2 ** 64."""
    lower = low(a) - low(b)
    return joined(high(a) - high(b) + F.shiftright(lower, 32), lower)


def mul64(x: Column, y: Column | int) -> Column:
    """x * y modulo 2 ** 64, by 16-bit limbs of y."""
    if isinstance(y, Column):
        limbs = [F.shiftrightunsigned(y, 16 * i).bitwiseAND(F.lit(0xFFFF).cast("bigint")) for i in range(4)]
    else:
        limbs = [F.lit(y % TWO_64 >> 16 * i & 0xFFFF).cast("bigint") for i in range(4)]
    mask = F.lit(0xFFFF).cast("bigint")
    lower, upper = low(x), high(x)
    products = [lower * c for c in limbs]
    q0, q1 = upper * limbs[0], upper * limbs[1]
    shifted = lambda p: F.shiftleft(p.bitwiseAND(mask), 16)
    bottom = products[0] + shifted(products[1])
    top = high(bottom) + F.shiftrightunsigned(products[1], 16) + products[2] + shifted(products[3]) + q0 + shifted(q1)
    return joined(top, bottom)


def wrapped_to(value: Column, bits: int, is_signed: bool) -> Column:
    """An exact decimal reduced to a number of that many bits."""
    least = exact(-(1 << bits - 1) if is_signed else 0)
    return F.pmod(value - least, exact(1 << bits)) + least


def to_pattern(value: Column) -> Column:
    """The BIGINT with the bits of an unsigned 64-bit value in DECIMAL(20,0)."""
    return F.when(value >= exact(TWO_63), value - exact(TWO_64)).otherwise(value).cast("bigint")


def from_pattern(bits: Column) -> Column:
    """The unsigned value, in DECIMAL(20,0), of a BIGINT's bits."""
    wide = bits.cast("decimal(21,0)")
    return F.when(bits < 0, wide + exact(TWO_64)).otherwise(wide).cast("decimal(20,0)")


def hex_of(bits: Column) -> Column:
    """Sixteen lower-case hexadecimal digits of a BIGINT's bits."""
    return F.lower(F.lpad(F.hex(bits), 16, "0"))
