"""Compaction, conversion of selections, mask algebra and packed bitmaps."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import selection as S
from ..sources.tables import table
from ._base import Catalog

_MASKS = "(SELECT c_custkey AS pos, c_acctbal > 3000 AS a, c_nationkey % 2 = 0 AS b FROM customer)"


def _masks(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("pos"), (F.col("c_acctbal") > 3000).alias("a"), (F.col("c_nationkey") % 2 == 0).alias("b"))


def _orders(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("pos"), "o_totalprice", (F.col("o_custkey") % 3 == 0).alias("sel"), (F.expr("o_orderkey div 64") % 2 == 0).alias("clustered"))


def _large(spark, d):
    return table(spark, d, "part").select(F.col("p_partkey").alias("pos"), (F.col("p_size") > 25).alias("sel"))


def _packed_sql(source: str, condition: str) -> str:
    return f"""SELECT bucket, string_agg(printf('%02X', v::INT), '' ORDER BY b) AS bits FROM (
        SELECT pos // 32768 AS bucket, pos % 32768 // 8 AS b, sum(CASE WHEN {condition} THEN 1 << (pos % 8)::INT ELSE 0 END) AS v FROM {source} GROUP BY ALL) GROUP BY bucket"""


def register(catalog: Catalog) -> None:
    for name, column, text in (("filter_bitmap", "sel", "o_custkey % 3 = 0"), ("filter_clustered", "clustered", "o_orderkey // 64 % 2 = 0")):
        catalog.add(
            name,
            lambda spark, d, c=column: S.keep_selected(_orders(spark, d), F.col(c), "pos", "ord").select("ord", "pos", "o_totalprice"),
            f"SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS ord, o_orderkey AS pos, o_totalprice FROM orders WHERE {text}",
        )
    catalog.add(
        "filter_selvec",
        lambda spark, d: S.keep_listed(_orders(spark, d).select("pos", "o_totalprice"), S.positions(_orders(spark, d), F.col("pos") % 5 == 0, "pos"), "pos").select("ord", "idx", "o_totalprice"),
        "SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS ord, o_orderkey AS idx, o_totalprice FROM orders WHERE o_orderkey % 5 = 0",
    )
    catalog.add("filter_empty_selvec", lambda spark, d: S.keep_listed(_orders(spark, d).select("pos", "o_totalprice"), S.positions(_orders(spark, d), F.lit(False), "pos"), "pos").select("ord", "idx"), "SELECT o_orderkey AS ord, o_orderkey AS idx FROM orders WHERE false")
    catalog.add("bitmap_to_selvec", lambda spark, d: S.positions(_large(spark, d), F.col("sel"), "pos"), "SELECT row_number() OVER (ORDER BY p_partkey) - 1 AS ord, p_partkey AS idx FROM part WHERE p_size > 25")

    def back(spark, d):
        suppliers = table(spark, d, "supplier")
        return S.from_positions(S.positions(suppliers, F.col("s_suppkey") % 3 == 0, "s_suppkey", None), suppliers.count())

    catalog.add("selvec_to_bitmap", back, "SELECT s_suppkey AS pos, s_suppkey % 3 = 0 AS sel FROM supplier")

    def packed(spark, d):
        rows = _large(spark, d)
        return S.pack(rows, F.col("sel"), "pos", rows.count())

    catalog.add("bitmap_packed_bytes", lambda spark, d: packed(spark, d).select("bucket", F.hex("bits").alias("bits")), _packed_sql("(SELECT p_partkey AS pos, p_size FROM part)", "p_size > 25"))
    catalog.add("bitmap_round_trip", lambda spark, d: S.unpack(packed(spark, d), _large(spark, d).count()), "SELECT p_partkey AS pos, p_size > 25 AS sel FROM part")
    catalog.add("bitmap_packed_count", lambda spark, d: S.packed_count(packed(spark, d)), "SELECT count(*) AS count FROM part WHERE p_size > 25")
    for op, text in (("and", "a AND b"), ("or", "a OR b"), ("andnot", "a AND NOT b"), ("xor", "a <> b")):
        catalog.add(f"mask_{op}", lambda spark, d, op=op: _masks(spark, d).select("pos", S.combine(op, F.col("a"), F.col("b")).alias("sel")), f"SELECT pos, {text} AS sel FROM {_MASKS}")
    for op, text in (("and", "a AND b"), ("or", "a OR b"), ("andnot", "a AND NOT b"), ("xor", "a <> b")):

        def both(spark, d, op=op):
            rows = _masks(spark, d)
            n = rows.count()
            return S.combine_packed(op, S.pack(rows, F.col("a"), "pos", n), S.pack(rows, F.col("b"), "pos", n)).select("bucket", F.hex("bits").alias("bits"))

        catalog.add(f"mask_{op}_packed", both, _packed_sql(_MASKS, text))
    def inverse(spark, d):
        rows = _masks(spark, d)
        n = rows.count()
        return S.invert_packed(S.pack(rows, F.col("a"), "pos", n), n).select("bucket", F.hex("bits").alias("bits"))

    catalog.add("mask_not_packed", inverse, _packed_sql(_MASKS, "NOT a"))
    catalog.add("mask_not", lambda spark, d: _masks(spark, d).select("pos", S.invert(F.col("a")).alias("sel")), f"SELECT pos, NOT a AS sel FROM {_MASKS}")
    catalog.add("mask_popcount", lambda spark, d: _masks(spark, d).agg(S.popcount(F.col("a")).alias("count")), f"SELECT count(*) FILTER (WHERE a) AS count FROM {_MASKS}")
    for name, f, text in (("all", S.all_selected, "coalesce(bool_and(a), true)"), ("any", S.any_selected, "coalesce(bool_or(a), false)"), ("none", S.none_selected, "NOT coalesce(bool_or(a), false)")):
        catalog.add(f"mask_{name}", lambda spark, d, f=f: _masks(spark, d).groupBy("b").agg(f(F.col("a")).alias("result")), f"SELECT b, {text} AS result FROM {_MASKS} GROUP BY b")
        catalog.add(f"mask_{name}_empty", lambda spark, d, f=f: _masks(spark, d).where("pos < 0").agg(f(F.col("a")).alias("result")), f"SELECT {text} AS result FROM {_MASKS} WHERE pos < 0")
