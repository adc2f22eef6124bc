"""The ten element types, with the Spark type that stores each.

Spark has no unsigned types: u8, u16 and u32 are stored in the next wider signed type and u64 in DECIMAL(20,0).
"""

from __future__ import annotations

import struct
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

COMPARE_OPS = ("eq", "ne", "lt", "le", "gt", "ge")
MASK_OPS = ("and", "or", "andnot", "xor")
ARITH_OPS = ("add", "sub", "mul")


@dataclass(frozen=True)
class Kind:
    """An element type: its bits, whether signed or floating, and the Spark types of values and of sums."""

    name: str
    bits: int
    signed: bool
    floating: bool
    spark: str
    total: str

    @property
    def least(self) -> int | float:
        """The lowest finite value, which is the maximum of no values."""
        if self.floating:
            return -self.greatest
        return -(1 << self.bits - 1) if self.signed else 0

    @property
    def greatest(self) -> int | float:
        """The highest finite value, which is the minimum of no values."""
        if self.floating:
            return 1.7976931348623157e308 if self.bits == 64 else struct.unpack("<f", b"\xff\xff\x7f\x7f")[0]
        return (1 << self.bits - self.signed) - 1

    @property
    def total_range(self) -> tuple[int, int]:
        """The range of sums, a signed or unsigned number of 64 bits."""
        return (-(1 << 63), (1 << 63) - 1) if self.signed else (0, (1 << 64) - 1)

    def lit(self, value: int | float) -> Column:
        """A constant of this type."""
        if self.floating:
            return F.lit(float(value)).cast(self.spark)
        return exact(value).cast(self.spark)


def exact(value: int) -> Column:
    """A whole number as DECIMAL(38,0)."""
    return F.lit(str(int(value))).cast("decimal(38,0)")


I8 = Kind("i8", 8, True, False, "tinyint", "bigint")
I16 = Kind("i16", 16, True, False, "smallint", "bigint")
I32 = Kind("i32", 32, True, False, "int", "bigint")
I64 = Kind("i64", 64, True, False, "bigint", "bigint")
U8 = Kind("u8", 8, False, False, "smallint", "decimal(20,0)")
U16 = Kind("u16", 16, False, False, "int", "decimal(20,0)")
U32 = Kind("u32", 32, False, False, "bigint", "decimal(20,0)")
U64 = Kind("u64", 64, False, False, "decimal(20,0)", "decimal(20,0)")
F32 = Kind("f32", 32, True, True, "float", "float")
F64 = Kind("f64", 64, True, True, "double", "double")
KINDS = {k.name: k for k in (I8, I16, I32, I64, U8, U16, U32, U64, F32, F64)}
INTEGERS = tuple(k for k in KINDS.values() if not k.floating)


def as_column(value: Column | int | float, kind: Kind) -> Column:
    """A column as it is, a number as a constant of the type."""
    return value if isinstance(value, Column) else kind.lit(value)
