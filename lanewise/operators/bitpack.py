"""Bit-packed integers: value i has bits [i w, (i + 1) w) of a binary, least significant bit first."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.kinds import U64, Kind
from ..functions.wide import add64, from_pattern, to_pattern


def _check(width: int, kind: Kind) -> None:
    if kind.signed or kind.floating:
        raise ValueError("unpacked values are unsigned")
    if not 0 <= width <= kind.bits:
        raise ValueError(f"width {width} isn't within 0 to {kind.bits}")


def _bits(width: str) -> str:
    """SQL: bits [i w, (i + 1) w) of ``h``, the hexadecimal digits of all bytes from the last to the first, as a BIGINT pattern.

    They are within 17 digits, of which one number holds 16; the first digit of 17 is put on top of the others.
    """
    low = f"cast((i * {width}) % 4 as int)"
    digits = f"cast((i * {width} + {width} - 1) div 4 - (i * {width}) div 4 + 1 as int)"
    from_end = f"cast((i * {width}) div 4 as int)"
    last = f"cast(conv(substring(h, length(h) - {from_end} - least({digits}, 16) + 1, least({digits}, 16)), 16, -10) as bigint)"
    top = f"if({digits} > 16, shiftleft(cast(conv(substring(h, length(h) - {from_end} - 16, 1), 16, 10) as bigint), 64 - {low}), 0L)"
    mask = f"shiftrightunsigned(-1L, cast(64 - {width} as int))"
    return f"(shiftrightunsigned({last}, {low}) | if({low} = 0, 0L, {top})) & {mask}"


def _unpacked(packed: str, n: str, width: str, value, kind: Kind) -> Column:
    # Digits swapped in each byte, then all in reverse order: the number's own digits.
    number = rf"reverse(regexp_replace(hex(`{packed}`), '(.)(.)', '$2$1'))"
    patterns = f"transform(array({number}), h -> transform(sequence(0L, greatest({n}, 1L) - 1), i -> if({width} = 0, 0L, {_bits(f'greatest({width}, 1)')})))[0]"
    none = f"cast(array() as array<{kind.spark}>)"
    enough = F.expr(f"length(`{packed}`) * 8L >= {n} * {width}")
    made = F.when(F.expr(f"{n} = 0"), F.expr(none)).otherwise(F.transform(F.expr(patterns), value))
    return F.when(enough, made).when(F.col(f"`{packed}`").isNotNull(), F.raise_error(F.lit("packed data too short")))


def unpack(packed: str, n: int, width: int, kind: Kind, base: int = 0) -> Column:
    """An array of n values of ``width`` bits from the binary column ``packed``, each plus ``base``, wrapping at the type's width.

    A width of 0 gives n times the base and reads nothing. Fewer than ceil(n * width / 8) bytes raise an error.
    """
    _check(width, kind)
    if n == 0:
        return F.expr(f"cast(array() as array<{kind.spark}>)")
    base %= 1 << kind.bits
    if width == 0:
        return F.array_repeat(kind.lit(base), n)

    def value(pattern: Column) -> Column:
        if kind is U64:
            return from_pattern(add64(pattern, to_pattern(kind.lit(base))) if base else pattern)
        return (F.pmod(pattern + base, F.lit(1 << kind.bits).cast("bigint")) if base else pattern).cast(kind.spark)

    return _unpacked(packed, f"{n}L", f"{width}L", value, kind)


def unpack_by(packed: str, n: str, width: str, kind: Kind, base: str | None = None) -> Column:
    """As ``unpack``, with the count, the width and the base of each row in columns.

    A null among them gives null; a width outside of 0 to the type's bits, or a count below 0, raises an error. A base is a value of
    the type.
    """
    _check(0, kind)
    count, bits = f"cast(`{n}` as bigint)", f"cast(`{width}` as bigint)"

    def value(pattern: Column) -> Column:
        if kind is U64:
            return from_pattern(pattern if base is None else add64(pattern, to_pattern(F.col(f"`{base}`"))))
        return (pattern if base is None else F.pmod(pattern + F.col(f"`{base}`").cast("bigint"), F.lit(1 << kind.bits).cast("bigint"))).cast(kind.spark)

    known = F.expr(f"`{n}` is not null and `{width}` is not null" + (f" and `{base}` is not null" if base else ""))
    wrong = F.expr(f"{bits} not between 0 and {kind.bits} or {count} < 0")
    return F.when(known & wrong, F.raise_error(F.lit(f"width isn't within 0 to {kind.bits}, or count below 0"))).when(known, _unpacked(packed, count, bits, value, kind))


def pack(values: str, width: int) -> Column:
    """The binary that holds the values (BIGINT patterns) of the array column ``values``, its last byte filled with zeros.

    Values must fit in ``width`` bits, 0 to 64.
    """
    if not 0 <= width <= 64:
        raise ValueError("width isn't within 0 to 64")
    name = f"`{values}`"
    if width == 0:
        return F.unhex(F.lit(""))
    bit = f"if({{b}} div {width} < size({name}), shiftrightunsigned({name}[cast(least({{b}} div {width}, size({name}) - 1) as int)], cast({{b}} % {width} as int)) & 1, 0)"
    octet = " | ".join(f"shiftleft({bit.format(b=f'(8 * o + {k})')}, {k})" for k in range(8))
    count = f"cast(ceil(size({name}) * {width} / 8) as int)"
    return F.expr(f"if(size({name}) = 0, unhex(''), unhex(array_join(transform(sequence(0, greatest({count} - 1, 0)), o -> lpad(hex(cast({octet} as bigint)), 2, '0')), '')))")
