"""Reductions with exact semantics, and hashes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import reductions as R
from ..functions.hashing import with_combined, with_hash
from ..functions.kinds import F32, F64, I8, I16, I32, I64, KINDS, U8, U32, U64, Kind
from ..functions.wide import hex_of
from ..sources.tables import table
from ._base import NULLABLE_SIZE, ODD_EVENTS, PARTS, Catalog, odd_events, parts

GREATEST = "1.7976931348623157e308"
#: Sums over orders that overflow 64 bits.
BIG = "(o_orderkey % 8192) * 562949953421312"
_WRAP = "((((({0}) + 9223372036854775808::HUGEINT) % 18446744073709551616::HUGEINT) + 18446744073709551616::HUGEINT) % 18446744073709551616::HUGEINT - 9223372036854775808::HUGEINT)::BIGINT"


def _guarded(pick: str, none: str) -> str:
    return f"CASE WHEN coalesce(bool_or(isnan(v)), false) THEN 'NaN'::DOUBLE ELSE coalesce({pick}(v), {none}) END"


def register(catalog: Catalog) -> None:
    # Columns are made when a query is built: there may be no session yet.
    x, v, pos = (lambda: F.col("x")), (lambda: F.col("v")), (lambda: F.col("pos"))
    sel, chosen = (lambda: F.col("p_size") % 3 == 0), (lambda: F.col("sel"))
    for name, f, pick, none in (("min", R.minimum, "min", I32.greatest), ("max", R.maximum, "max", I32.least)):
        catalog.add(f"reduce_{name}", lambda spark, d, f=f: parts(spark, d).agg(f(x(), I32).cast("bigint").alias("result")), f"SELECT coalesce({pick}(x), {none})::BIGINT AS result FROM {PARTS}")
        catalog.add(f"reduce_{name}_sel", lambda spark, d, f=f: parts(spark, d).agg(f(x(), I32, sel()).cast("bigint").alias("result")), f"SELECT coalesce({pick}(x) FILTER (WHERE p_size % 3 = 0), {none})::BIGINT AS result FROM {PARTS}")
        catalog.add(f"reduce_{name}_empty", lambda spark, d, f=f: parts(spark, d).agg(f(x(), I32, F.lit(False)).cast("bigint").alias("result")), f"SELECT {none}::BIGINT AS result")
        number = GREATEST if name == "min" else f"-{GREATEST}"
        catalog.add(f"reduce_{name}_nan", lambda spark, d, f=f: odd_events(spark, d).agg(f(v(), F64, None, pos()).alias("result")), f"SELECT {_guarded(pick, number)} AS result FROM {ODD_EVENTS}")
        catalog.add(f"reduce_{name}_f64", lambda spark, d, f=f: odd_events(spark, d).agg(f(v(), F64, pos() % 11 != 0, pos()).alias("result")), f"SELECT {_guarded(pick, number)} AS result FROM {ODD_EVENTS} WHERE pos % 11 <> 0")
        catalog.add(f"reduce_{name}_f64_empty", lambda spark, d, f=f: odd_events(spark, d).agg(f(v(), F64, F.lit(False)).alias("result")), f"SELECT ({number})::DOUBLE AS result")
    big = lambda spark, d: table(spark, d, "orders").select(F.col("o_orderkey").alias("pos"), F.expr(BIG).alias("x"), (F.col("o_custkey") % 3 == 0).alias("sel"))
    big_sql = f"(SELECT ({BIG})::HUGEINT AS x, o_custkey % 3 = 0 AS sel FROM orders)"
    catalog.add("sum_wrap_i64", lambda spark, d: big(spark, d).agg(R.sum_wrapping(x(), I64).alias("total")), f"SELECT {_WRAP.format('sum(x)')} AS total FROM {big_sql}")
    catalog.add("sum_wrap_sel", lambda spark, d: big(spark, d).agg(R.sum_wrapping(x(), I64, F.col("sel")).alias("total")), f"SELECT {_WRAP.format('sum(x)')} AS total FROM {big_sql} WHERE sel")
    catalog.add("sum_wrap_empty", lambda spark, d: big(spark, d).agg(R.sum_wrapping(x(), I64, F.lit(False)).alias("total")), "SELECT 0::BIGINT AS total")
    catalog.add("sum_wrap_i32", lambda spark, d: parts(spark, d).agg(R.sum_wrapping(x(), I32).alias("total")), f"SELECT sum(x)::BIGINT AS total FROM {PARTS}")
    catalog.add("sum_wrap_u32", lambda spark, d: big(spark, d).agg(R.sum_wrapping((F.lit(1 << 32) - 1 - pos()).cast("bigint"), U32).cast("string").alias("total")), "SELECT sum(4294967295 - o_orderkey)::VARCHAR AS total FROM orders")
    catalog.add("sum_wrap_u64", lambda spark, d: big(spark, d).agg(R.sum_wrapping(x().cast("decimal(20,0)") * 3 % F.lit("18446744073709551616").cast("decimal(20,0)"), U64).cast("string").alias("total")), f"SELECT (sum(x * 3 % 18446744073709551616::HUGEINT) % 18446744073709551616::HUGEINT)::VARCHAR AS total FROM {big_sql}")
    catalog.add("sum_f64_strict", lambda spark, d: R.sum_in_order(odd_events(spark, d), v(), pos(), F64, pos() % 11 != 0).withColumnRenamed("value", "total"), f"SELECT list_reduce(list(v ORDER BY pos), lambda a, b: a + b) AS total FROM {ODD_EVENTS} WHERE pos % 11 <> 0 AND v IS NOT NULL")
    catalog.add("sum_f32_strict", lambda spark, d: R.sum_in_order(odd_events(spark, d), v().cast("float"), pos(), F32, pos() % 11 != 0).select(F.col("value").cast("double").alias("total")), f"SELECT list_reduce(list(v::FLOAT ORDER BY pos), lambda a, b: (a + b)::FLOAT)::DOUBLE AS total FROM {ODD_EVENTS} WHERE pos % 11 <> 0 AND v IS NOT NULL")
    catalog.add("sum_f64_fast", lambda spark, d: odd_events(spark, d).agg(F.round(R.sum_wrapping(v(), F64, pos() % 11 != 0), 3).alias("total")), f"SELECT round(sum(v), 3) AS total FROM {ODD_EVENTS} WHERE pos % 11 <> 0")
    for name, only, where in (("", None, "true"), ("_sel", chosen, "sel")):
        catalog.add(
            f"sum_checked_overflow{name}",
            lambda spark, d, only=only: big(spark, d).agg(R.sum_checked(x(), I64, only and only()).alias("s")).select("s.value", "s.overflowed"),
            f"SELECT {_WRAP.format('sum(x)')} AS value, sum(x) NOT BETWEEN -9223372036854775808::HUGEINT AND 9223372036854775807::HUGEINT AS overflowed FROM {big_sql} WHERE {where}",
        )
    catalog.add("sum_checked_transient", lambda spark, d: big(spark, d).agg(R.sum_checked(F.when(pos() % 2 == 0, F.lit(1 << 62)).otherwise(F.lit(-(1 << 62))), I64).alias("s")).select("s.value", "s.overflowed"), f"SELECT {_WRAP.format('sum(CASE WHEN o_orderkey % 2 = 0 THEN 4611686018427387904 ELSE -4611686018427387904 END::HUGEINT)')} AS value, false AS overflowed FROM orders")
    catalog.add("sum_checked_narrow", lambda spark, d: big(spark, d).agg(R.sum_checked((pos() % 128).cast("tinyint"), I8).alias("s")).select("s.value", "s.overflowed"), "SELECT sum(o_orderkey % 128)::BIGINT AS value, false AS overflowed FROM orders")
    catalog.add("sum_checked_grouped", lambda spark, d: big(spark, d).groupBy((pos() % 10).alias("g")).agg(R.sum_checked(x(), I64).alias("s")).select("g", "s.value", "s.overflowed"), f"SELECT g, {_WRAP.format('sum(x)')} AS value, sum(x) NOT BETWEEN -9223372036854775808::HUGEINT AND 9223372036854775807::HUGEINT AS overflowed FROM (SELECT o_orderkey % 10 AS g, ({BIG})::HUGEINT AS x FROM orders) GROUP BY g")
    for name, only, where in (("", None, "true"), ("_sel", sel, "p_size % 3 = 0")):
        catalog.add(
            f"min_max_summary{name}",
            lambda spark, d, only=only: parts(spark, d).agg(R.min_max(x(), I32, only and only()).alias("s")).select(F.col("s.min").cast("bigint").alias("lowest"), F.col("s.max").cast("bigint").alias("highest"), "s.null_count"),
            f"SELECT coalesce(min(x), {I32.greatest})::BIGINT AS lowest, coalesce(max(x), {I32.least})::BIGINT AS highest, count(*) FILTER (WHERE x IS NULL) AS null_count FROM {PARTS} WHERE {where}",
        )
        catalog.add(f"count_valid{name}", lambda spark, d, only=only: parts(spark, d).agg(R.count_valid(x(), only and only()).alias("n")), f"SELECT count(x) AS n FROM {PARTS} WHERE {where}")
    for kind in KINDS.values():
        _extremes(catalog, kind)
    for kind in (F32, F64):
        for batch in (1000, R.BATCH):
            _blocked(catalog, kind, batch)
    _hashes(catalog)


def _spread(kind: Kind) -> str:
    """Values of orders over much of a type's range, every ninth null; the same text in both engines."""
    if kind.floating:
        return "case when o_orderkey % 9 = 4 then null else o_totalprice - 100000 end"
    span = min(1 << kind.bits, 1 << 53)
    least = f" - {span // 2}" if kind.signed else ""
    return f"case when o_orderkey % 9 = 4 then null else (o_orderkey * 7919 + o_custkey * 104729) % {span}{least} end"


def _extremes(catalog: Catalog, kind: Kind) -> None:
    """Minimum, maximum and the summary of them with the nulls, over all rows and over selected ones."""
    shown = (lambda c: c.cast("double")) if kind.floating else (lambda c: c.cast("string"))
    cast = f"{'FLOAT' if kind.bits == 32 else 'DOUBLE'})::DOUBLE" if kind.floating else "HUGEINT)::VARCHAR"

    def query(spark, d):
        x, only, pos = F.col("x"), F.col("sel"), F.col("pos") if kind.floating else None
        rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("pos"), F.expr(_spread(kind)).cast(kind.spark).alias("x"), (F.col("o_custkey") % 3 == 0).alias("sel"))
        both = rows.agg(
            shown(R.minimum(x, kind, None, pos)).alias("lowest"),
            shown(R.maximum(x, kind, None, pos)).alias("highest"),
            shown(R.minimum(x, kind, only, pos)).alias("lowest_selected"),
            shown(R.maximum(x, kind, only, pos)).alias("highest_selected"),
            R.min_max(x, kind, only, pos).alias("s"),
        )
        return both.select("lowest", "highest", "lowest_selected", "highest_selected", shown(F.col("s.min")).alias("summary_min"), shown(F.col("s.max")).alias("summary_max"), F.col("s.null_count").alias("null_count"))

    value = lambda f, where="": f"(({f}(x){where})::{cast}"
    chosen = " FILTER (WHERE sel)"
    catalog.add(
        f"reduce_extremes_{kind.name}",
        query,
        f"""SELECT {value('min')} AS lowest, {value('max')} AS highest, {value('min', chosen)} AS lowest_selected, {value('max', chosen)} AS highest_selected,
            {value('min', chosen)} AS summary_min, {value('max', chosen)} AS summary_max, count(*) FILTER (WHERE sel AND x IS NULL) AS null_count
            FROM (SELECT ({_spread(kind)})::{'FLOAT' if kind.spark == 'float' else 'DOUBLE' if kind.floating else 'HUGEINT'} AS x, o_custkey % 3 = 0 AS sel FROM orders)""",
    )


def _blocked(catalog: Catalog, kind: Kind, batch: int) -> None:
    """Sums in the blocked order, to the last bit; every eleventh value takes no part."""
    name = "FLOAT" if kind is F32 else "DOUBLE"
    lanes = R.LANES[kind.bits]
    block = R.ACCUMULATORS * lanes

    def query(spark, d):
        value = F.when(F.col("pos") % 11 != 0, F.col("v")).cast(kind.spark)
        return R.sum_floats(odd_events(spark, d), value, F.col("pos"), kind) if batch == R.BATCH else R.sum_blocked(odd_events(spark, d), value, F.col("pos"), kind, batch)

    fold = f"lambda s, x: (s + x)::{name}"
    zero = f"0::{name}"
    added = f"(({{0}})::{name} + ({{1}})::{name})::{name}"
    pair = added.format(added.format("a[j]", f"a[j + {2 * lanes}]"), added.format(f"a[j + {lanes}]", f"a[j + {3 * lanes}]"))
    catalog.add(
        f"sum_{kind.name}_blocked_{batch}",
        lambda spark, d: query(spark, d).select(F.col("value").cast("double").alias("total")),
        f"""WITH e AS (SELECT pos // {batch} AS batch, pos % {batch} AS place, (CASE WHEN pos % 11 <> 0 AND v IS NOT NULL THEN v ELSE '-0.0'::DOUBLE END)::{name} AS v FROM {ODD_EVENTS}),
        sized AS (SELECT batch, count(*) AS n FROM e GROUP BY batch),
        lanes AS (SELECT batch, place % {block} AS lane, list_reduce(list_prepend({zero}, list(v ORDER BY place)), {fold}) AS s
            FROM e JOIN sized USING (batch) WHERE place < n // {block} * {block} GROUP BY ALL),
        whole AS (SELECT batch, list(s ORDER BY lane) AS a FROM lanes GROUP BY batch),
        combined AS (SELECT batch, list_reduce(list_prepend({zero}, list_transform(range(1, {lanes + 1}), lambda j: {pair})), {fold}) AS s FROM whole),
        tails AS (SELECT batch, list(v ORDER BY place) AS t FROM e JOIN sized USING (batch) WHERE place >= n // {block} * {block} GROUP BY batch),
        batches AS (SELECT batch, list_reduce(list_prepend(coalesce(s, {zero}), coalesce(t, [])), {fold}) AS total FROM sized LEFT JOIN combined USING (batch) LEFT JOIN tails USING (batch))
        SELECT list_reduce(list_prepend({zero}, list(total ORDER BY batch)), {fold})::DOUBLE AS total FROM batches""",
    )


def _mixed(bits: str) -> str:
    """SQL of the finaliser over an unsigned 64-bit expression, and its result as a signed BIGINT; built as nested selects."""
    multiply = "((xor(h, h >> 33)::UHUGEINT * {0}::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT"
    inner = f"SELECT k, ({bits})::UBIGINT AS h FROM source"
    for factor in ("18397679294719823053", "14181476777654086739"):
        inner = f"SELECT k, {multiply.format(factor)} AS h FROM ({inner})"
    return f"SELECT k, (CASE WHEN h > 9223372036854775807 THEN h::HUGEINT - 18446744073709551616 ELSE h::HUGEINT END)::BIGINT AS h FROM (SELECT k, xor(h, h >> 33) AS h FROM ({inner}))"


def _seeded(key: str, seed: int) -> str:
    return f"xor({key}, {(seed + 0x9E3779B97F4A7C15) % (1 << 64)}::UBIGINT)"


def _hashes(catalog: Catalog) -> None:
    orders = lambda spark, d: table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("x"))
    unsigned = lambda e, bits: f"(CASE WHEN ({e}) < 0 THEN ({e})::HUGEINT + {1 << bits} ELSE ({e})::HUGEINT END)::UBIGINT"
    source = "WITH source AS (SELECT o_orderkey AS k, o_custkey AS x FROM orders) "
    for name, kind, text, cast, seed in (
        ("hash64_i64", I64, "x - 500", "bigint", 0),
        ("hash64_seeded", I64, "x", "bigint", 7),
        ("hash64_i32", I32, "x - 500", "int", 0),
        ("hash64_i16_neg", I16, "x % 1000 - 500", "smallint", 3),
        ("hash64_i8_neg", I8, "x % 256 - 128", "tinyint", 3),
        ("hash64_u8", U8, "x % 256", "smallint", 3),
    ):
        catalog.add(name, lambda spark, d, x=text, c=cast, k=kind, s=seed: with_hash(orders(spark, d), "h", F.expr(x).cast(c), k, s).select("k", "h"), source + _mixed(_seeded(unsigned(text, kind.bits), seed)))
    catalog.add("hash64_hex", lambda spark, d: with_hash(orders(spark, d), "h", F.col("x"), I64).select("k", hex_of(F.col("h")).alias("h")), source + f"SELECT k, lower(printf('%016x', (CASE WHEN h < 0 THEN h::HUGEINT + 18446744073709551616 ELSE h::HUGEINT END)::UBIGINT)) AS h FROM ({_mixed(_seeded('x::UBIGINT', 0))})")
    catalog.add("hash64_null", lambda spark, d: with_hash(parts(spark, d), "h", F.col("x"), I32, 1, 42).select(F.col("pos").alias("k"), "h"), f"WITH source AS (SELECT p_partkey AS k, {NULLABLE_SIZE} AS x FROM part) SELECT k, coalesce(h, 42) AS h FROM ({_mixed(_seeded('x::UBIGINT', 1))})")
    clean = f"SELECT pos AS k, CASE WHEN v = 0 THEN 0.0::DOUBLE ELSE v END AS x FROM {ODD_EVENTS} WHERE pos % 11 <> 0"
    catalog.add("hash64_f64", lambda spark, d: with_hash(odd_events(spark, d).where("pos % 11 <> 0"), "h", F.col("v"), F64, 7).select(F.col("pos").alias("k"), "h"), f"WITH source AS ({clean}) " + _mixed(_seeded("cast(cast(x AS BIT) AS UBIGINT)", 7)))
    catalog.add("hash64_f32", lambda spark, d: with_hash(odd_events(spark, d).where("pos % 11 <> 0"), "h", F.col("v").cast("float"), F32, 7).select(F.col("pos").alias("k"), "h"), f"WITH source AS ({clean}) " + _mixed(_seeded("cast(cast(x::FLOAT AS BIT) AS UINTEGER)::UBIGINT", 7)))
    both = "xor(a, ((b::UHUGEINT + 11400714819323198485::UHUGEINT + ((a::UHUGEINT << 6) % 18446744073709551616::UHUGEINT) + (a >> 2)::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT)"
    catalog.add("hash_combine", lambda spark, d: with_combined(orders(spark, d), "h", "x", "k").select("k", "h"), "WITH source AS (SELECT o_orderkey AS k, o_custkey::UBIGINT AS a, o_orderkey::UBIGINT AS b FROM orders) " + _mixed(both))
