import pytest
from model import clamp, exact, wrap
from pyspark.sql import functions as F

from lanewise.functions.arith import checked, saturating, wrapping
from lanewise.functions.kinds import ARITH_OPS, F32, F64, I32, INTEGERS
from lanewise.plans.arith_queries import boundaries


@pytest.mark.parametrize("kind", INTEGERS, ids=lambda k: k.name)
@pytest.mark.parametrize("ansi", ["true", "false"])
def test_all_pairs_of_boundaries(spark, kind, ansi):
    values = [*boundaries(kind), kind.greatest // 2 + 1, 3]
    pairs = [(a, b) for a in values for b in values]
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        df = spark.createDataFrame([(i, str(a), str(b)) for i, (a, b) in enumerate(pairs)], "pos long, a string, b string").select("pos", F.col("a").cast(kind.spark).alias("a"), F.col("b").cast(kind.spark).alias("b"))
        a, b = F.col("a"), F.col("b")
        rows = df.select("pos", *[wrapping(op, a, b, kind).alias(f"w_{op}") for op in ARITH_OPS], *[checked(op, a, b, kind).alias(f"c_{op}") for op in ARITH_OPS], *[saturating(op, a, b, kind).alias(f"s_{op}") for op in ARITH_OPS]).collect()
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)
    for row in rows:
        x, y = pairs[row["pos"]]
        for op in ARITH_OPS:
            e = exact(op, x, y)
            assert row[f"w_{op}"] == wrap(e, kind), (op, x, y)
            assert (row[f"c_{op}"]["value"], row[f"c_{op}"]["overflowed"]) == (wrap(e, kind), wrap(e, kind) != e), (op, x, y)
            assert row[f"s_{op}"] == clamp(e, kind), (op, x, y)


def test_nulls_give_null(spark):
    df = spark.createDataFrame([(1, None), (None, 2), (None, None), (3, 4)], "a int, b int")
    a, b = F.col("a"), F.col("b")
    rows = df.select(wrapping("add", a, b, I32), checked("mul", a, b, I32), saturating("sub", a, b, I32)).collect()
    assert [tuple(r) for r in rows[:3]] == [(None, None, None)] * 3
    assert rows[3][0] == 7


def test_floats_keep_their_type(spark):
    df = spark.createDataFrame([(0.1, 3.0)], "a float, b float")
    out = df.select(wrapping("mul", F.col("a"), 3, F32).alias("x"), wrapping("add", F.col("a").cast("double"), 1, F64).alias("y"))
    assert [f.dataType.simpleString() for f in out.schema] == ["float", "double"]
    with pytest.raises(ValueError):
        checked("add", F.col("a"), F.col("b"), F32)
