"""A frozen 64-bit hash of keys, and its combination over several columns.

``with_hash`` and ``with_combined`` add a column step by step: each step is a projection that refers to the one before, all in one stage
of generated code. ``hash64`` and ``combine`` are the same as one expression; it binds its parts by lambda variables, which Spark
interprets row by row, so for large tables the step-by-step forms are the faster ones.

Hashes are BIGINT bit patterns; ``wide.from_pattern`` and ``wide.hex_of`` show them unsigned or in hexadecimal. The hash of null is
null unless the caller names one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kinds import U64, Kind
from .names import free
from .wide import add64, long, mul64, to_pattern

# Fixed values of the hash.
GOLDEN = 0x9E3779B97F4A7C15
FACTOR_1 = 0xFF51AFD7ED558CCD
FACTOR_2 = 0xC4CEB9FE1A85EC53


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body refers to it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def finalise(x: Column) -> Column:
    """The 64-bit finaliser of MurmurHash3."""
    folded = lambda h: h.bitwiseXOR(F.shiftrightunsigned(h, 33))
    x = _let(_let(x, folded), lambda h: mul64(h, FACTOR_1))
    x = _let(_let(x, folded), lambda h: mul64(h, FACTOR_2))
    return _let(x, folded)


def float_bits(value: Column, kind: Kind) -> Column:
    """The bit pattern of a float as BIGINT, 32 bits for f32; -0.0 counts as 0.0, NaN keeps its payload."""
    owner, method, bits = ("java.lang.Float", "floatToRawIntBits", 0xFFFFFFFF) if kind.bits == 32 else ("java.lang.Double", "doubleToRawLongBits", -1)
    known = F.when(value == 0, kind.lit(0)).when(value.isNotNull(), value).otherwise(kind.lit(0))
    pattern = F.reflect(F.lit(owner), F.lit(method), known).cast("bigint").bitwiseAND(F.lit(bits).cast("bigint"))
    return F.when(value.isNotNull(), pattern)


def key_bits(value: Column, kind: Kind) -> Column:
    """The 64 bits that are hashed: integers as their own bits with zeros above, floats by ``float_bits``."""
    if kind.floating:
        return float_bits(value, kind)
    if kind is U64:
        return to_pattern(value)
    wide = value.cast("bigint")
    return wide if kind.bits == 64 or not kind.signed else wide.bitwiseAND(F.lit((1 << kind.bits) - 1).cast("bigint"))


def hash64(value: Column, kind: Kind, seed: int = 0, null_hash: int | None = None) -> Column:
    """The hash of a value under a seed."""
    out = finalise(key_bits(value, kind).bitwiseXOR(long(seed + GOLDEN)))
    return out if null_hash is None else F.coalesce(out, long(null_hash))


def combine(a: Column, b: Column) -> Column:
    """The hash of two hashes, in this order."""
    mixed = lambda p: add64(add64(p["b"], long(GOLDEN)), add64(F.shiftleft(p["a"], 6), F.shiftrightunsigned(p["a"], 2)))
    return finalise(_let(F.struct(a.alias("a"), b.alias("b")), lambda p: p["a"].bitwiseXOR(mixed(p))))


def _finalised(rows: DataFrame, name: str) -> DataFrame:
    h = F.col(f"`{name}`")
    for factor in (FACTOR_1, FACTOR_2):
        rows = rows.withColumn(name, h.bitwiseXOR(F.shiftrightunsigned(h, 33))).withColumn(name, mul64(h, factor))
    return rows.withColumn(name, h.bitwiseXOR(F.shiftrightunsigned(h, 33)))


def with_hash(rows: DataFrame, name: str, value: Column, kind: Kind, seed: int = 0, null_hash: int | None = None) -> DataFrame:
    """``rows`` with the column ``name``: the hash of a value under a seed."""
    out = _finalised(rows.withColumn(name, key_bits(value, kind).bitwiseXOR(long(seed + GOLDEN))), name)
    return out if null_hash is None else out.withColumn(name, F.coalesce(F.col(f"`{name}`"), long(null_hash)))


def with_combined(rows: DataFrame, name: str, first: str, second: str) -> DataFrame:
    """``rows`` with the column ``name``: the hash of the hashes in two columns, in this order."""
    a, b = F.col(f"`{first}`"), F.col(f"`{second}`")
    part = free(rows.columns, "part")
    other = free([*rows.columns, part], "other")
    rows = rows.withColumn(part, add64(b, long(GOLDEN))).withColumn(other, F.shiftleft(a, 6))
    rows = rows.withColumn(other, add64(F.col(other), F.shiftrightunsigned(a, 2)))
    rows = rows.withColumn(part, add64(F.col(part), F.col(other))).withColumn(part, a.bitwiseXOR(F.col(part)))
    return _finalised(rows, part).withColumn(name, F.col(part)).drop(part, other)
