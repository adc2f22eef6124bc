"""Reductions as aggregate expressions, usable in ``agg`` with or without groups.

A value takes part if it is not null and selected. ``only`` is the selection: a boolean column without nulls, or None for all
rows. Nothing selected means no value, never all values.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .kinds import U64, Kind, exact
from .wide import to_pattern, wrapped_to

_LIMB = 22


def _taking_part(value: Column, only: Column | None) -> Column:
    return value if only is None else F.when(only, value)


def _extreme(value: Column, kind: Kind, only: Column | None, pos: Column | None, smallest: bool) -> Column:
    value = _taking_part(value, only)
    pick = F.min if smallest else F.max
    none = kind.lit(kind.greatest if smallest else kind.least)
    if not kind.floating:
        return F.coalesce(pick(value), none)
    # A struct with a null field would sort first; NaN is looked for on its own.
    if pos is None:
        best = pick(value)
    else:
        best = pick(F.when(value.isNotNull(), F.struct(value.alias("v"), (pos if smallest else -pos).alias("p"))))["v"]
    return F.when(F.coalesce(F.bool_or(F.isnan(value) & value.isNotNull()), F.lit(False)), kind.lit(float("nan"))).otherwise(F.coalesce(best, none))


def minimum(value: Column, kind: Kind, only: Column | None = None, pos: Column | None = None) -> Column:
    """The least value; the type's greatest if there is none; NaN if any is NaN. With ``pos``, of 0.0 and -0.0 the first."""
    return _extreme(value, kind, only, pos, True)


def maximum(value: Column, kind: Kind, only: Column | None = None, pos: Column | None = None) -> Column:
    """The greatest value; the type's lowest if there is none; NaN if any is NaN. With ``pos``, of 0.0 and -0.0 the first."""
    return _extreme(value, kind, only, pos, False)


def exact_sum(value: Column, kind: Kind, only: Column | None = None) -> Column:
    """The exact sum of integers as DECIMAL(38,0), 0 for none.

    Wide integers are summed by limbs of 22 bits in BIGINT, which is exact for 2 ** 41 rows and stays in generated code; those of u64
    are the limbs of its 64 bits.
    """
    value = _taking_part(value, only)
    wide = to_pattern(value) if kind is U64 else value.cast("bigint")
    shift = F.shiftrightunsigned if kind is U64 else F.shiftright
    limbs = -(-kind.bits // _LIMB) if kind.bits > 16 else 1
    total = exact(0)
    for i in range(limbs):
        part = shift(wide, _LIMB * i) if i else wide
        if i < limbs - 1:
            part = part.bitwiseAND(F.lit((1 << _LIMB) - 1).cast("bigint"))
        total = total + (F.coalesce(F.sum(part), F.lit(0)).cast("decimal(20,0)") * exact(1 << _LIMB * i).cast("decimal(15,0)")).cast("decimal(38,0)")
    return total.cast("decimal(38,0)")


def sum_wrapping(value: Column, kind: Kind, only: Column | None = None) -> Column:
    """Integers: the sum modulo 2 ** 64 in the type's sum type. Floats: a sum in no fixed order, see ``sum_blocked`` and ``sum_in_order``."""
    if kind.floating:
        return F.coalesce(F.sum(_taking_part(value, only)), F.lit(0.0)).cast(kind.total)
    return wrapped_to(exact_sum(value, kind, only), 64, kind.signed).cast(kind.total)


def sum_checked(value: Column, kind: Kind, only: Column | None = None) -> Column:
    """A struct of the wrapped sum ``value`` and whether the exact sum ``overflowed`` the sum type. Integers only."""
    if kind.floating:
        raise ValueError("checked sums are defined for integers")
    total = exact_sum(value, kind, only)
    least, greatest = kind.total_range
    return F.struct(wrapped_to(total, 64, kind.signed).cast(kind.total).alias("value"), (~total.between(exact(least), exact(greatest))).alias("overflowed"))


def min_max(value: Column, kind: Kind, only: Column | None = None, pos: Column | None = None) -> Column:
    """A struct of ``min``, ``max`` and ``null_count``, the selected rows whose value is null."""
    missing = value.isNull() if only is None else value.isNull() & only
    return F.struct(minimum(value, kind, only, pos).alias("min"), maximum(value, kind, only, pos).alias("max"), F.count_if(missing).alias("null_count"))


def count_valid(value: Column, only: Column | None = None) -> Column:
    """How many values take part."""
    return F.count(_taking_part(value, only))


def sum_in_order(rows: DataFrame, value: Column, pos: Column, kind: Kind, only: Column | None = None) -> DataFrame:
    """One row with ``value``: the strict left fold of floats in order of ``pos``, each step rounded to the type.

    A fold in a fixed order has no parallel form. Rows are sorted with spilling and folded as they stream by: memory stays
    bounded, but one task reads all values that take part. ``sum_blocked`` is the parallel form in a fixed order.
    """
    if not kind.floating:
        raise ValueError("sums of integers don't depend on order")
    number, arrow = (np.float32, pa.float32()) if kind.bits == 32 else (np.float64, pa.float64())
    kept = rows.select(pos.alias("pos"), _taking_part(value, only).alias("value")).where("value is not null")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = number(0)
        with np.errstate(all="ignore"):
            for batch in batches:
                if batch.num_rows:
                    total = np.cumsum(np.concatenate([[total], batch.column(1).to_numpy()]).astype(number), dtype=number)[-1]
        yield pa.RecordBatch.from_arrays([pa.array([total], arrow)], names=["value"])

    folded = kept.repartition(1).sortWithinPartitions("pos").mapInArrow(fold, f"value {kind.spark}")
    return folded.agg(F.coalesce(F.first("value"), kind.lit(0)).alias("value"))


# Fixed values of the blocked order: accumulators, and lanes in each by bits of the type.
ACCUMULATORS = 4
LANES = {32: 8, 64: 4}
#: Positions of a batch.
BATCH = 1 << 16


def _folded(values: str, kind: Kind) -> str:
    """SQL: the left fold of an array from 0, each step rounded to the type."""
    zero = f"cast(0 as {kind.spark})"
    return f"aggregate({values}, {zero}, (s, x) -> cast(s + x as {kind.spark}))"


def _batch_sum(values: str, kind: Kind) -> str:
    """SQL: the blocked sum of a batch's values in order of position, -0.0 for those that take no part (it changes no sum)."""
    lanes = LANES[kind.bits]
    block = ACCUMULATORS * lanes
    whole = f"(size(v) div {block})"
    column = lambda lane: f"if({whole} = 0, cast(array() as array<{kind.spark}>), transform(sequence(0, greatest({whole} - 1, 0)), i -> v[cast(i * {block} + {lane} as int)]))"
    sums = f"transform(sequence(0, {block - 1}), j -> {_folded(column('j'), kind)})"
    rounded = lambda a, b: f"cast({a} + {b} as {kind.spark})"
    pair = rounded(rounded("a[j]", f"a[j + {2 * lanes}]"), rounded(f"a[j + {lanes}]", f"a[j + {3 * lanes}]"))
    combined = f"transform(array({sums}), a -> transform(sequence(0, {lanes - 1}), j -> {pair}))[0]"
    tail = f"slice(v, {whole} * {block} + 1, size(v) - {whole} * {block})"
    return f"transform(array({values}), v -> aggregate({tail}, {_folded(combined, kind)}, (s, x) -> cast(s + x as {kind.spark})))[0]"


def batch_sums(rows: DataFrame, value: Column, pos: Column, kind: Kind, batch: int = BATCH) -> DataFrame:
    """(batch, value): the blocked sum of floats of each run of ``batch`` positions, nulls left out.

    A fixed order that has a parallel form. Positions are dense from 0, rows with nulls among them. Of a batch, whole blocks of
    ACCUMULATORS times LANES values are added lane by lane in order; accumulators are combined as (0 + 2) + (1 + 3); lanes are
    folded from the first on; the values after the last whole block follow one by one. Each step is rounded to the type. A task holds
    one batch at a time.
    """
    if not kind.floating:
        raise ValueError("sums of integers don't depend on order")
    neutral = F.coalesce(value.cast(kind.spark), F.lit("-0.0").cast(kind.spark))
    kept = rows.select((pos.cast("bigint") - F.pmod(pos.cast("bigint"), F.lit(batch).cast("bigint"))).alias("from"), pos.alias("pos"), neutral.alias("value"))
    ordered = kept.groupBy("from").agg(F.array_sort(F.collect_list(F.struct("pos", "value"))).alias("all"))
    number = F.expr(f"`from` div {batch}").alias("batch")
    return ordered.select(number, F.expr("transform(all, x -> x.value)").alias("v")).select("batch", F.expr(_batch_sum("v", kind)).alias("value"))


def sum_blocked(rows: DataFrame, value: Column, pos: Column, kind: Kind, batch: int = BATCH) -> DataFrame:
    """One row with ``value``: the batches' sums of ``batch_sums``, folded in order. Each is added in parallel; one number a batch meets in one task."""
    return sum_in_order(batch_sums(rows, value, pos, kind, batch), F.col("value"), F.col("batch"), kind)


def sum_floats(rows: DataFrame, value: Column, pos: Column, kind: Kind, only: Column | None = None, strict: bool = False) -> DataFrame:
    """One row with ``value``: a sum in a fixed order, strict if asked for or under a selection, else blocked."""
    if strict or only is not None:
        return sum_in_order(rows, value, pos, kind, only)
    return sum_blocked(rows, value, pos, kind)
