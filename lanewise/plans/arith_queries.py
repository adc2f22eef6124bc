"""Elementwise arithmetic over pairs of boundary values of each type."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.arith import checked, overflows, saturating, wrapping
from ..functions.kinds import ARITH_OPS, F32, F64, I8, I64, INTEGERS, U64, Kind
from ..sources.tables import table
from ._base import Catalog

SIGNS = {"add": "+", "sub": "-", "mul": "*"}


def boundaries(kind: Kind) -> list[int]:
    return [kind.least, kind.least + 1, -1 if kind.signed else 2, 0, 1, kind.greatest - 1, kind.greatest]


def operands(spark, d, kind: Kind):
    """All pairs of boundary values, over the keys of orders."""
    values = F.array(*[kind.lit(x) for x in boundaries(kind)])
    at = lambda e: F.element_at(values, F.expr(e).cast("int"))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("pos"), at("o_orderkey % 7 + 1").alias("a"), at("o_orderkey div 7 % 7 + 1").alias("b"))


def _shown(column, kind: Kind):
    return column.cast("string") if kind is U64 else column.cast("bigint")


def _source(kind: Kind) -> str:
    values = "[" + ", ".join(f"({x})::HUGEINT" for x in boundaries(kind)) + "]"
    return f"(SELECT o_orderkey AS pos, {values}[o_orderkey % 7 + 1] AS a, {values}[o_orderkey // 7 % 7 + 1] AS b FROM orders)"


def _exact(op: str, kind: Kind, right: str = "b") -> str:
    return f"(a::UHUGEINT * {right}::UHUGEINT)" if kind is U64 and op == "mul" else f"(a {SIGNS[op]} {right})"


def _wrapped(op: str, kind: Kind, right: str = "b") -> str:
    e, least, span = _exact(op, kind, right), kind.least, 1 << kind.bits
    shown = "VARCHAR" if kind is U64 else "BIGINT"
    if kind is U64 and op == "mul":
        return f"({e} % {span}::UHUGEINT)::{shown}"
    return f"((({e} - ({least})::HUGEINT) % {span}::HUGEINT + {span}::HUGEINT) % {span}::HUGEINT + ({least})::HUGEINT)::{shown}"


def _over(op: str, kind: Kind, right: str = "b") -> str:
    e = _exact(op, kind, right)
    if kind is U64 and op == "mul":
        return f"({e} > {kind.greatest}::UHUGEINT)"
    return f"({e} NOT BETWEEN ({kind.least})::HUGEINT AND ({kind.greatest})::HUGEINT)"


def _clamped(op: str, kind: Kind, right: str = "b") -> str:
    e, shown = _exact(op, kind, right), "VARCHAR" if kind is U64 else "BIGINT"
    if kind is U64 and op == "mul":
        return f"least({e}, {kind.greatest}::UHUGEINT)::{shown}"
    return f"least(greatest({e}, ({kind.least})::HUGEINT), ({kind.greatest})::HUGEINT)::{shown}"


def register(catalog: Catalog) -> None:
    a, b = (lambda: F.col("a")), (lambda: F.col("b"))  # there may be no session yet
    for kind in INTEGERS:
        for op in ARITH_OPS:
            catalog.add(f"arith_{op}_{kind.name}", lambda spark, d, k=kind, op=op: operands(spark, d, k).select("pos", _shown(wrapping(op, a(), b(), k), k).alias("value")), f"SELECT pos, {_wrapped(op, kind)} AS value FROM {_source(kind)}")
            catalog.add(
                f"checked_{op}_{kind.name}",
                lambda spark, d, k=kind, op=op: operands(spark, d, k).select("pos", checked(op, a(), b(), k).alias("s")).select("pos", _shown(F.col("s.value"), k).alias("value"), "s.overflowed"),
                f"SELECT pos, {_wrapped(op, kind)} AS value, {_over(op, kind)} AS overflowed FROM {_source(kind)}",
            )
            catalog.add(f"saturating_{op}_{kind.name}", lambda spark, d, k=kind, op=op: operands(spark, d, k).select("pos", _shown(saturating(op, a(), b(), k), k).alias("value")), f"SELECT pos, {_clamped(op, kind)} AS value FROM {_source(kind)}")
    for kind in (I8, I64):
        catalog.add(
            f"arith_scalar_{kind.name}",
            lambda spark, d, k=kind: operands(spark, d, k).select("pos", wrapping("add", a(), 100, k).cast("bigint").alias("sum"), checked("mul", a(), 3, k)["overflowed"].alias("over"), saturating("sub", a(), 100, k).cast("bigint").alias("clamped")),
            f"SELECT pos, {_wrapped('add', kind, '100::HUGEINT')} AS sum, {_over('mul', kind, '3::HUGEINT')} AS over, {_clamped('sub', kind, '100::HUGEINT')} AS clamped FROM {_source(kind)}",
        )
    for kind in INTEGERS:
        _scalars(catalog, kind)
    catalog.add("checked_count", lambda spark, d: operands(spark, d, I64).agg(*[F.count_if(overflows(op, a(), b(), I64)).alias(op) for op in ARITH_OPS]), "SELECT " + ", ".join(f"count(*) FILTER (WHERE {_over(op, I64)}) AS {op}" for op in ARITH_OPS) + f" FROM {_source(I64)}")
    nullable = lambda spark, d: table(spark, d, "orders").select(F.col("o_orderkey").alias("pos"), F.expr("nullif(o_custkey % 11, 0)").alias("a"), F.expr("nullif(o_orderkey % 7, 0)").alias("b"))
    catalog.add("arith_validity", lambda spark, d: nullable(spark, d).select("pos", wrapping("mul", a(), b(), I64).alias("value"), (a().isNotNull() & b().isNotNull()).alias("valid")), "SELECT pos, a * b AS value, a IS NOT NULL AND b IS NOT NULL AS valid FROM (SELECT o_orderkey AS pos, nullif(o_custkey % 11, 0) AS a, nullif(o_orderkey % 7, 0) AS b FROM orders)")
    for kind, cast in ((F32, "FLOAT"), (F64, "DOUBLE")):
        catalog.add(
            f"arith_{kind.name}",
            lambda spark, d, k=kind: table(spark, d, "events").select(F.col("event_id").alias("pos"), *[wrapping(op, F.col("value").cast(k.spark), 0.1, k).cast("double").alias(op) for op in ARITH_OPS]),
            f"SELECT event_id AS pos, " + ", ".join(f"(value::{cast} {s} 0.1::{cast})::{cast}::DOUBLE AS {op}" for op, s in SIGNS.items()) + " FROM events",
        )


def _scalars(catalog: Catalog, kind: Kind) -> None:
    """All operations of a column with a constant, in all three forms."""
    constant = 100 if kind.bits == 8 else kind.greatest - 5
    right = f"({constant})::HUGEINT"

    def query(spark, d):
        a = F.col("a")
        columns = []
        for op in ARITH_OPS:
            guarded = checked(op, a, constant, kind)
            columns += [
                _shown(wrapping(op, a, constant, kind), kind).alias(f"{op}_wrapped"),
                guarded["overflowed"].alias(f"{op}_over"),
                _shown(guarded["value"], kind).alias(f"{op}_checked"),
                _shown(saturating(op, a, constant, kind), kind).alias(f"{op}_clamped"),
            ]
        return operands(spark, d, kind).select("pos", *columns)

    shown = []
    for op in ARITH_OPS:
        wrapped = _wrapped(op, kind, right)
        shown += [f"{wrapped} AS {op}_wrapped", f"{_over(op, kind, right)} AS {op}_over", f"{wrapped} AS {op}_checked", f"{_clamped(op, kind, right)} AS {op}_clamped"]
    catalog.add(f"arith_scalars_{kind.name}", query, f"SELECT pos, {', '.join(shown)} FROM {_source(kind)}")
