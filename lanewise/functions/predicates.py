"""Predicates with two values: a row is selected or not, never unknown.

A null operand selects nothing. NaN is unequal to all, itself too, and in no order with anything; -0.0 equals 0.0. The plain
comparison stays visible to the optimiser, so filters still reach the scan.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .kinds import COMPARE_OPS, Kind, as_column


def selected(condition: Column) -> Column:
    """The condition, with null as false. Negate only what has passed through here.

    As a conjunction, so that a filter by it is split and the plain condition reaches the scan.
    """
    return condition & condition.isNotNull()


def compare(op: str, left: Column, right: Column | int | float, kind: Kind) -> Column:
    """Whether ``left op right`` holds; op is one of COMPARE_OPS, right a column or a number."""
    if op not in COMPARE_OPS:
        raise ValueError(f"unknown comparison {op!r}")
    other = as_column(right, kind)
    plain = {"eq": left == other, "ne": left != other, "lt": left < other, "le": left <= other, "gt": left > other, "ge": left >= other}[op]
    if not kind.floating:
        return selected(plain)
    sides = [left, other] if isinstance(right, Column) or right != right else [left]
    if op == "ne":
        return selected(reduce(lambda c, x: c | F.isnan(x), sides, plain) & left.isNotNull() & other.isNotNull())
    return selected(reduce(lambda c, x: c & ~F.isnan(x), sides, plain))


def between(value: Column, low: Column | int | float, high: Column | int | float, kind: Kind) -> Column:
    """Whether low <= value <= high."""
    return compare("ge", value, low, kind) & compare("le", value, high, kind)
