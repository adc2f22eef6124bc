import math
import random

import numpy as np
import pytest
from model import combine as combined
from model import hash64 as hashed
from model import key, minimum
from pyspark.sql import functions as F

from lanewise.functions import reductions as R
from lanewise.functions.hashing import combine, hash64, with_combined, with_hash
from lanewise.functions.kinds import F32, F64, I8, I16, I32, I64, INTEGERS, KINDS, U8, U64
from lanewise.functions.wide import add64, from_pattern, hex_of, mul64, signed, sub64


def frame(spark, values, kind, parts=2):
    stored = "double" if kind.floating else "string"
    rows = [(i, None if v is None else v if kind.floating else str(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, f"pos long, x {stored}").repartition(parts).select("pos", F.col("x").cast(kind.spark).alias("x"))


@pytest.fixture(autouse=True)
def columns(spark):
    global X, POS
    X, POS = F.col("x"), F.col("pos")


def test_participation(spark):
    df = frame(spark, [5, 1, None, 2, 7], I32)
    only = POS.isin(1, 2, 4)
    row = df.agg(R.minimum(X, I32, only), R.maximum(X, I32, only), R.sum_wrapping(X, I32, only), R.min_max(X, I32, only).alias("s"), R.count_valid(X, only), R.count_valid(X)).first()
    assert tuple(row[:3]) == (1, 7, 8)
    assert tuple(row["s"]) == (1, 7, 1)
    assert tuple(row[4:]) == (2, 4)


@pytest.mark.parametrize("kind", list(KINDS.values()), ids=lambda k: k.name)
def test_identities(spark, kind):
    for df in (frame(spark, [None, None], kind), frame(spark, [1.0 if kind.floating else 1], kind).where("pos > 5")):
        row = df.agg(R.minimum(X, kind), R.maximum(X, kind), R.sum_wrapping(X, kind)).first()
        assert tuple(row) == (kind.greatest, kind.least, 0)


def test_nan_and_zeros(spark):
    df = frame(spark, [3.0, float("nan"), 1.0], F64)
    row = df.agg(R.minimum(X, F64), R.maximum(X, F64), R.minimum(X, F64, POS != 1), R.maximum(X, F64, POS != 1)).first()
    assert math.isnan(row[0]) and math.isnan(row[1]) and tuple(row[2:]) == (1.0, 3.0)
    for zeros in ([0.0, -0.0, None], [-0.0, 0.0, None]):
        df = frame(spark, zeros, F64)
        row = df.agg(R.minimum(X, F64, None, POS), R.maximum(X, F64, None, POS)).first()
        assert [math.copysign(1, v) for v in row] == [math.copysign(1, zeros[0])] * 2


def test_sums(spark):
    top = (1 << 63) - 1
    value = lambda values, kind: tuple(frame(spark, values, kind).agg(R.sum_checked(X, kind).alias("s")).first()["s"])
    assert value([top, 1], I64) == (-(1 << 63), True)
    assert value([top, 1, -1], I64) == (top, False)
    assert value([(1 << 64) - 1, 2], U64) == (1, True)
    assert value([127, 127, 127], I8) == (381, False)
    assert value([-(1 << 63), -(1 << 63), -1, None], I64) == (-1, True)
    for kind in INTEGERS:
        values = [kind.least, kind.greatest, kind.greatest, 1, None, 0]
        total = sum(v for v in values if v is not None)
        span = 1 << 64
        expected = (total + (span // 2 if kind.signed else 0)) % span - (span // 2 if kind.signed else 0)
        assert frame(spark, values, kind).agg(R.sum_wrapping(X, kind)).first()[0] == expected


@pytest.mark.parametrize("parts", [1, 2, 7])
def test_strict_sum(spark, parts):
    df = frame(spark, [1e16, 1.0, -1e16, 1.0, None], F64, parts)
    assert R.sum_in_order(df, X, POS, F64).first()["value"] == 1.0
    assert R.sum_in_order(df, X, POS, F64, F.lit(False)).first()["value"] == 0.0
    narrow = frame(spark, [16777216.0, 1.0, 1.0], F32, parts)
    assert R.sum_in_order(narrow, X, POS, F32).first()["value"] == 16777216.0


def test_grouped(spark):
    df = frame(spark, [3, 1, None, 2, 9, 4], I16).withColumn("g", POS % 2)
    rows = {r["g"]: r for r in df.groupBy("g").agg(R.minimum(X, I16).alias("lo"), R.maximum(X, I16).alias("hi"), R.sum_wrapping(X, I16).alias("s")).collect()}
    assert tuple(rows[0])[1:] == (minimum([3, None, 9], I16), 9, 12)
    assert tuple(rows[1])[1:] == (1, 4, 7)


def test_wide_arithmetic(spark):
    values = [0, 1, 2, -1, -2, (1 << 63) - 1, -(1 << 63), 0x123456789ABCDEF, 1 << 32, (1 << 32) - 1, -(1 << 32)]
    pairs = [(a, b) for a in values for b in values]
    df = spark.createDataFrame(list(enumerate(pairs)), "pos long, p struct<a:long,b:long>")
    a, b = F.col("p.a"), F.col("p.b")
    for row in df.select("pos", add64(a, b), sub64(a, b), mul64(a, b), mul64(a, 0xFF51AFD7ED558CCD)).collect():
        x, y = pairs[row[0]]
        assert list(row[1:]) == [signed(x + y), signed(x - y), signed(x * y), signed(x * 0xFF51AFD7ED558CCD)]


def test_hashes(spark):
    cases = [(U8, [0, 255], 3), (I8, [-1, 5], 3), (I64, [0, 1, -1, 42], 0), (I64, [42], 99), (U64, [0, (1 << 64) - 1], 0), (F64, [1.0, -0.0, 0.0, -2.5], 7), (F32, [1.0, -0.0, 3.4e38], 7)]
    for kind, values, seed in cases:
        rows = frame(spark, [*values, None], kind).select("pos", hash64(X, kind, seed).alias("h"), X).orderBy("pos").collect()
        assert [r["h"] for r in rows[:-1]] == [signed(hashed(key(r["x"] if kind.floating else int(r["x"]), kind), seed)) for r in rows[:-1]]
        assert rows[-1]["h"] is None
    row = spark.createDataFrame([(0, 1, 42)], "a long, b long, c long").select(hex_of(hash64(F.col("a"), I64)), hex_of(hash64(F.col("b"), I64)), hex_of(hash64(F.col("c"), I64, 99)), from_pattern(combine(F.lit(1).cast("long"), F.lit(2).cast("long")))).first()
    assert tuple(row[:3]) == ("9ca066f1a4ab2eea", "25b775faeca8f520", "7b778b89cf7b1b81")
    assert int(row[3]) == combined(1, 2) == 0xF9122D6051144CC9


def test_hashes_step_by_step(spark):
    df = spark.createDataFrame([(0, 1, 2), (1, -5, 7), (2, None, 3)], "pos long, x long, y long")
    out = with_combined(with_hash(with_hash(df, "h", X, I64, 5), "g", F.col("y"), I64, 6, 9), "c", "h", "g")
    rows = out.select("h", "g", "c", hash64(X, I64, 5).alias("h2"), combine(F.col("h"), F.col("g")).alias("c2"), combine(hash64(X, I64, 5), hash64(F.col("y"), I64, 6, 9)).alias("c3")).collect()
    assert out.columns == ["pos", "x", "y", "h", "g", "c"]
    assert all(r["h"] == r["h2"] and r["c"] == r["c2"] == r["c3"] for r in rows)


def blocked(values, kind):
    """The blocked order of one batch, written out."""
    number = np.float32 if kind.bits == 32 else np.float64
    lanes = R.LANES[kind.bits]
    block = 4 * lanes
    x = [number(-0.0) if v is None else number(v) for v in values]
    acc = [number(0)] * block
    whole = len(x) // block * block
    for i in range(whole):
        acc[i % block] += x[i]
    total = number(0)
    for j in range(lanes):
        total += (acc[j] + acc[j + 2 * lanes]) + (acc[j + lanes] + acc[j + 3 * lanes])
    for v in x[whole:]:
        total += v
    return total


@pytest.mark.parametrize("kind", [F32, F64], ids=lambda k: k.name)
@pytest.mark.parametrize("n", [0, 1, 15, 16, 33, 64, 1000])
def test_blocked_sums(spark, kind, n):
    rng = random.Random(n)
    values = [None if rng.random() < 0.1 else rng.choice([1e16, 1.0, -1e16, 0.1, rng.random()]) for _ in range(n)]
    for parts in (1, 5):
        got = R.sum_blocked(frame(spark, values, kind, parts) if n else frame(spark, [1.0], kind).where("pos < 0"), X, POS, kind).first()["value"]
        assert got == float(blocked(values, kind))
    if n == 1000:
        sums = [blocked(values[i : i + 64], kind) for i in range(0, n, 64)]
        got = R.batch_sums(frame(spark, values, kind, 5), X, POS, kind, 64).orderBy("batch").collect()
        assert [r["value"] for r in got] == [float(s) for s in sums]
        total = type(sums[0])(0)
        for s in sums:
            total += s
        assert R.sum_blocked(frame(spark, values, kind, 5), X, POS, kind, 64).first()["value"] == float(total)
        strict = type(sums[0])(0)
        for v in values:
            strict += type(strict)(v) if v is not None else 0
        assert R.sum_floats(frame(spark, values, kind, 3), X, POS, kind, strict=True).first()["value"] == float(strict)


def test_sums_of_u64_beyond_decimals(spark):
    """The exact sum of many greatest values stays exact where a narrower decimal would be null."""
    df = spark.range(3).select(F.lit("18446744073709551615").cast("decimal(20,0)").alias("x"))
    assert df.agg(R.exact_sum(F.col("x"), U64)).first()[0] == 3 * ((1 << 64) - 1)
    assert "decimal(30" not in df.agg(R.exact_sum(F.col("x"), U64).alias("s"))._jdf.queryExecution().analyzed().toString().lower()
