"""Predicates: bitmap and list forms, against a constant, another column and a range."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.kinds import F32, F64, I32, I64, INTEGERS
from ..functions.predicates import between, compare
from ..operators.selection import positions
from ..sources.tables import table
from ._base import ODD_EVENTS, PAIRS, PARTS, SIGNS, Catalog, odd_events, pairs, parts


def register(catalog: Catalog) -> None:
    for op, sign in SIGNS.items():
        catalog.add(
            f"cmp_{op}_bitmap",
            lambda spark, d, op=op: parts(spark, d).select("pos", compare(op, F.col("x"), 4, I32).alias("sel")),
            f"SELECT pos, coalesce(x {sign} 4, false) AS sel FROM {PARTS}",
        )
        catalog.add(
            f"cmp_cols_{op}_bitmap",
            lambda spark, d, op=op: pairs(spark, d).select("pos", compare(op, F.col("a"), F.col("b"), I64).alias("sel")),
            f"SELECT pos, coalesce(a {sign} b, false) AS sel FROM {PAIRS}",
        )
        catalog.add(f"cmp_{op}_selvec", lambda spark, d, op=op: positions(parts(spark, d), compare(op, F.col("x"), 4, I32), "pos"), _listed(PARTS, f"x {sign} 4"))
        catalog.add(f"cmp_cols_{op}_selvec", lambda spark, d, op=op: positions(pairs(spark, d), compare(op, F.col("a"), F.col("b"), I64), "pos"), _listed(PAIRS, f"a {sign} b"))
        catalog.add(f"cmp_nan_{op}", _floats(op), _floats_sql(op, sign))
    catalog.add("between_bitmap", lambda spark, d: parts(spark, d).select("pos", between(F.col("x"), 3, 7, I32).alias("sel")), f"SELECT pos, coalesce(x BETWEEN 3 AND 7, false) AS sel FROM {PARTS}")
    catalog.add("between_selvec", lambda spark, d: positions(parts(spark, d), between(F.col("x"), 3, 7, I32), "pos"), _listed(PARTS, "x BETWEEN 3 AND 7"))
    catalog.add(
        "between_nan_bitmap",
        lambda spark, d: odd_events(spark, d).select("pos", between(F.col("v"), 0.0, 100.0, F64).alias("sel")),
        f"SELECT pos, coalesce(v BETWEEN 0.0 AND 100.0 AND NOT isnan(v), false) AS sel FROM {ODD_EVENTS}",
    )
    catalog.add("cmp_every_type", _every_type, _every_type_sql())


def _listed(source: str, condition: str) -> str:
    return f"SELECT row_number() OVER (ORDER BY pos) - 1 AS ord, pos AS idx FROM {source} WHERE {condition}"


def _floats(op: str):
    def query(spark, d):
        v, f = F.col("v"), F.col("v").cast("float")
        return odd_events(spark, d).select(
            "pos", compare(op, v, 100.0, F64).alias("number"), compare(op, v, float("nan"), F64).alias("nan"), compare(op, v, 0.0, F64).alias("zero"), compare(op, v, v, F64).alias("self"), compare(op, f, 100.0, F32).alias("narrow")
        )

    return query


def _floats_sql(op: str, sign: str) -> str:
    def guarded(left: str, right: str, either: str) -> str:
        return f"coalesce({left} {sign} {right} OR {either}, false)" if op == "ne" else f"coalesce({left} {sign} {right} AND NOT ({either}), false)"

    nan = "v IS NOT NULL" if op == "ne" else "false"
    return f"""SELECT pos, {guarded("v", "100.0::DOUBLE", "isnan(v)")} AS number, {nan} AS nan, {guarded("v", "0.0::DOUBLE", "isnan(v)")} AS zero,
        {guarded("v", "v", "isnan(v)")} AS self, {guarded("v::FLOAT", "100.0::FLOAT", "isnan(v)")} AS narrow FROM {ODD_EVENTS}"""


def _every_type(spark, d):
    key = F.col("o_orderkey")
    counts = []
    for kind in INTEGERS:
        value = F.when(key % 5 != 0, F.pmod(key, F.lit(256)) - (128 if kind.signed else 0)).cast(kind.spark)
        counts.append(F.count_if(compare("ge", value, 100, kind)).alias(kind.name))
    return table(spark, d, "orders").agg(*counts)


def _every_type_sql() -> str:
    counts = [f"count(*) FILTER (WHERE o_orderkey % 5 <> 0 AND o_orderkey % 256 - {128 if k.signed else 0} >= 100) AS {k.name}" for k in INTEGERS]
    return f"SELECT {', '.join(counts)} FROM orders"
