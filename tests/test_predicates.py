import pytest
from model import compare as expected
from pyspark.sql import functions as F

from lanewise.functions.kinds import COMPARE_OPS, F32, F64, I8, I32, INTEGERS, U16, Kind
from lanewise.functions.predicates import between, compare
from lanewise.operators.selection import positions


def frame(spark, values, kind, parts=2):
    rows = [(i, None if v is None else v if kind.floating else str(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "pos long, x double" if kind.floating else "pos long, x string").repartition(parts).select("pos", F.col("x").cast(kind.spark).alias("x"))


def bits(df, column):
    return [r[0] for r in df.orderBy("pos").select(column).collect()]


def test_greater_than(spark):
    df = frame(spark, [5, -1, 7, 7, 0, 100, -100, 7], I32)
    assert bits(df, compare("gt", F.col("x"), 6, I32)) == [False, False, True, True, False, True, False, True]


def test_null_is_not_selected_and_its_negation_is(spark):
    df = frame(spark, [7, None, 7, None], I32)
    hit = compare("eq", F.col("x"), 7, I32)
    assert bits(df, hit) == [True, False, True, False]
    assert bits(df, ~hit) == [False, True, False, True]


def test_nan_and_zero(spark):
    df = frame(spark, [1.0, float("nan"), -0.0, 3.0], F64)
    nan = float("nan")
    assert bits(df, compare("eq", F.col("x"), nan, F64)) == [False] * 4
    assert bits(df, compare("ne", F.col("x"), nan, F64)) == [True] * 4
    assert bits(df, compare("eq", F.col("x"), 0.0, F64)) == [False, False, True, False]
    for op in ("lt", "le", "gt", "ge"):
        assert bits(df, compare(op, F.col("x"), nan, F64)) == [False] * 4


def test_between_and_list(spark):
    df = frame(spark, [9, 10, 15, 20, 21], U16)
    assert bits(df, between(F.col("x"), 10, 20, U16)) == [False, True, True, True, False]
    df = frame(spark, [1, 5, 1, 5, 5], I8)
    assert sorted(map(tuple, positions(df, compare("eq", F.col("x"), 5, I8), "pos").select("ord", "idx").collect())) == [(0, 1), (1, 3), (2, 4)]


@pytest.mark.parametrize("kind", [*INTEGERS, F32, F64], ids=lambda k: k.name)
def test_all_operators_at_the_boundaries(spark, kind: Kind):
    values = [None, *([float("nan"), float("inf"), -float("inf"), 0.0, -0.0, 1.5] if kind.floating else [kind.least, kind.least + 1, 0, 1, kind.greatest - 1, kind.greatest])]
    pairs = [(i, a, b) for i, (a, b) in enumerate((a, b) for a in values for b in values)]
    stored, text = ("double", lambda x: x) if kind.floating else ("string", lambda x: None if x is None else str(x))
    df = spark.createDataFrame([(i, text(a), text(b)) for i, a, b in pairs], f"pos long, a {stored}, b {stored}").select("pos", F.col("a").cast(kind.spark).alias("a"), F.col("b").cast(kind.spark).alias("b"))
    rows = df.select("pos", *[compare(op, F.col("a"), F.col("b"), kind).alias(op) for op in COMPARE_OPS]).collect()
    for row in rows:
        _, a, b = pairs[row["pos"]]
        for op in COMPARE_OPS:
            assert row[op] == expected(op, a, b), (op, a, b)


def test_pushdown(spark, tmp_path):
    frame(spark, [1, 2, 3], I32).write.parquet(str(tmp_path / "t"))
    plan = spark.read.parquet(str(tmp_path / "t")).where(compare("gt", F.col("x"), 1, I32))._jdf.queryExecution().toString()
    assert "GreaterThan(x,1)" in plan


def test_unknown_operator():
    with pytest.raises(ValueError):
        compare("like", None, 1, I32)
