"""Gather and dictionary decode, and unpacking of bit-packed integers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.kinds import U8, U16, U32, U64
from ..functions.wide import to_pattern
from ..operators.bitpack import pack, unpack, unpack_by
from ..operators.gather import dict_decode, take, take_from_array
from ..sources.tables import table
from ._base import Catalog

#: Values in one packed binary.
GROUP = 40


def register(catalog: Catalog) -> None:
    indices = lambda spark, d: table(spark, d, "orders").select(F.col("o_orderkey").alias("ord"), (99 - F.col("o_orderkey") % 10).alias("idx"))
    catalog.add(
        "take_reverse_dup",
        lambda spark, d: take(indices(spark, d), table(spark, d, "part"), "idx", "p_partkey", "p_retailprice"),
        "SELECT o_orderkey AS ord, 99 - o_orderkey % 10 AS idx, p_retailprice FROM orders JOIN part ON p_partkey = 99 - o_orderkey % 10",
    )
    catalog.add(
        "take_column_by_column",
        lambda spark, d: take(table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("idx")), table(spark, d, "customer"), "idx", "c_custkey", "c_acctbal"),
        "SELECT o_orderkey, o_custkey AS idx, c_acctbal FROM orders JOIN customer ON c_custkey = o_custkey",
    )
    catalog.add(
        "take_from_array",
        lambda spark, d: table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", take_from_array(F.array("l_orderkey", "l_partkey", "l_suppkey"), (F.col("l_linenumber") % 3)).alias("value")),
        "SELECT l_orderkey, l_linenumber, [l_orderkey, l_partkey, l_suppkey][l_linenumber % 3 + 1] AS value FROM lineitem",
    )
    nations = lambda spark, d: table(spark, d, "nation").select(F.col("n_nationkey").alias("code"), F.col("n_name").alias("value"))
    customers = lambda spark, d: table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("nation"), (F.col("c_acctbal") > 3000).alias("sel"))
    catalog.add("dict_decode", lambda spark, d: dict_decode(customers(spark, d).select("c_custkey", "nation"), nations(spark, d), "nation").select("c_custkey", "value"), "SELECT c_custkey, n_name AS value FROM customer JOIN nation ON n_nationkey = c_nationkey")
    catalog.add(
        "dict_decode_selected",
        lambda spark, d: dict_decode(customers(spark, d).withColumn("nation", F.expr("if(sel, nation, 255)")), nations(spark, d), "nation", selection=F.col("sel")).select("c_custkey", "value"),
        "SELECT c_custkey, n_name AS value FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_acctbal > 3000",
    )

    def groups(spark, d, value: str):
        """Arrays of GROUP values each, in order of the key; a last shorter group is filled up with zeros."""
        rows = table(spark, d, "part").select(F.expr(f"p_partkey div {GROUP}").alias("g"), F.expr(f"p_partkey % {GROUP}").alias("i"), F.expr(value).cast("bigint").alias("v"))
        packed = rows.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("all"))
        full = F.concat(F.expr("transform(all, s -> s.v)"), F.array_repeat(F.lit(0).cast("bigint"), GROUP - F.size("all")))
        return packed.select("g", full.alias("vs"))

    def unpacked(spark, d, width, kind, base, value):
        made = groups(spark, d, value).select("g", pack("vs", width).alias("bits")).select("g", F.posexplode(unpack("bits", GROUP, width, kind, base)).alias("i", "v"))
        v = F.col("v")
        return made.select("g", F.col("i").cast("bigint").alias("i"), (to_pattern(v) if kind is U64 else v.cast("bigint")).alias("v"))

    for width, kind in ((1, U8), (3, U8), (6, U8), (8, U8), (11, U16), (13, U16), (16, U16), (24, U32), (31, U32), (32, U32), (40, U64), (57, U64), (61, U64), (62, U64), (63, U64), (64, U64)):
        value = f"(p_partkey * 2654435761 + p_size) % {min(1 << width, 1 << 40)}"
        catalog.add(
            f"unpack_w{width}",
            lambda spark, d, w=width, k=kind, v=value: unpacked(spark, d, w, k, 0, v),
            f"SELECT range // {GROUP} AS g, range % {GROUP} AS i, coalesce({value}, 0)::BIGINT AS v FROM range(((SELECT max(p_partkey) FROM part) // {GROUP} + 1) * {GROUP}) LEFT JOIN part ON p_partkey = range",
        )
    catalog.add(
        "unpack_w0_for",
        lambda spark, d: groups(spark, d, "p_size").select("g", F.posexplode(unpack("g", GROUP, 0, U32, 77)).alias("i", "v")).select("g", F.col("i").cast("bigint").alias("i"), "v"),
        f"SELECT range // {GROUP} AS g, range % {GROUP} AS i, 77::BIGINT AS v FROM range(((SELECT max(p_partkey) FROM part) // {GROUP} + 1) * {GROUP})",
    )
    for name, width, kind, base, modulus in (("unpack_for_u8_wrap", 6, U8, 250, 256), ("unpack_for_u16", 6, U16, 1000, 65536), ("unpack_for_u32", 6, U32, 4294967290, 4294967296)):
        catalog.add(
            name,
            lambda spark, d, w=width, k=kind, b=base: unpacked(spark, d, w, k, b, "p_size"),
            f"SELECT range // {GROUP} AS g, range % {GROUP} AS i, ((coalesce(p_size, 0)::BIGINT + {base}) % {modulus})::BIGINT AS v FROM range(((SELECT max(p_partkey) FROM part) // {GROUP} + 1) * {GROUP}) LEFT JOIN part ON p_partkey = range",
        )
    catalog.add(
        "unpack_for_u64_wrap",
        lambda spark, d: unpacked(spark, d, 6, U64, (1 << 64) - 10, "p_size"),
        f"SELECT range // {GROUP} AS g, range % {GROUP} AS i, coalesce(p_size, 0)::BIGINT - 10 AS v FROM range(((SELECT max(p_partkey) FROM part) // {GROUP} + 1) * {GROUP}) LEFT JOIN part ON p_partkey = range",
    )
    # Count, width and base of each row in columns: counts from 0 to 40, widths from 24 to 64.
    by_row = {"n": "(g * 7) % 41", "w": "24 + g % 41", "base": "g * 1000003"}

    def by_columns(spark, d):
        made = groups(spark, d, "p_partkey * 2654435761 % 16777216")
        wide = made.select("g", "vs", *[F.expr(e).alias(c) for c, e in by_row.items()])
        bits = "case " + " ".join(f"when w = {w} then p{w}" for w in (24, 37, 64)) + " end"
        some = wide.where("w in (24, 37, 64)").select("*", *[pack("vs", w).alias(f"p{w}") for w in (24, 37, 64)])
        made = some.select("g", "n", "w", F.col("base").cast("decimal(20,0)").alias("base"), F.expr(bits).alias("bits"))
        return made.select("g", F.posexplode(unpack_by("bits", "n", "w", U64, "base")).alias("i", "v")).select("g", F.col("i").cast("bigint").alias("i"), to_pattern(F.col("v")).alias("v"))

    catalog.add(
        "unpack_by_columns",
        by_columns,
        f"""SELECT g, i, (coalesce(p_partkey * 2654435761 % 16777216, 0) + g * 1000003)::BIGINT AS v
            FROM (SELECT range // {GROUP} AS g, range % {GROUP} AS i, range AS k FROM range(((SELECT max(p_partkey) FROM part) // {GROUP} + 1) * {GROUP})) LEFT JOIN part ON p_partkey = k
            WHERE 24 + g % 41 IN (24, 37, 64) AND i < (g * 7) % 41""",
    )
