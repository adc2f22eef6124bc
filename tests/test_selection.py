import random

import pytest
from pyspark.sql import functions as F

from lanewise.operators import selection as S


def frame(spark, flags, parts=3):
    return spark.createDataFrame(list(enumerate(flags)), "pos long, sel boolean").repartition(parts)


def test_filter_keeps_order(spark):
    flags = [bool(0xA5 >> i & 1) for i in range(8)]
    df = frame(spark, flags).withColumn("v", (F.col("pos") + 1) * 10)
    out = S.keep_selected(df, F.col("sel"), "pos", "ord").orderBy("ord").select("ord", "v").collect()
    assert [tuple(r) for r in out] == [(0, 10), (1, 30), (2, 60), (3, 80)]
    listed = spark.createDataFrame([(0, 1), (1, 3)], "ord long, idx long")
    assert sorted(r["v"] for r in S.keep_listed(df, listed, "pos").collect()) == [20, 40]
    assert S.keep_listed(df, listed.limit(0), "pos").count() == 0


def test_ordinals_over_many_runs(spark, monkeypatch):
    monkeypatch.setattr(S, "RUN", 7)
    df = spark.range(100).where("id % 3 = 1").withColumnRenamed("id", "pos")
    assert [tuple(r) for r in S.numbered(df, "pos").orderBy("pos").select("ord", "pos").collect()] == [(i, 3 * i + 1) for i in range(33)]


def test_list_to_bitmap(spark):
    listed = spark.createDataFrame([(0, 0), (1, 9)], "ord long, idx long")
    flags = [r["sel"] for r in S.from_positions(listed, 11).orderBy("pos").collect()]
    assert flags == [i in (0, 9) for i in range(11)]


@pytest.mark.parametrize("n", [1, 7, 8, 9, 64, 257])
def test_packed_round_trip(spark, n):
    random.seed(n)
    flags = [random.random() < 0.4 for _ in range(n)]
    packed = S.pack(frame(spark, flags), F.col("sel"), "pos", n)
    expected = sum(f << i for i, f in enumerate(flags)).to_bytes(-(-n // 8), "little")
    assert bytes(packed.first()["bits"]) == expected
    assert [r["sel"] for r in S.unpack(packed, n).orderBy("pos").collect()] == flags
    assert S.packed_count(packed).first()["count"] == sum(flags)


def test_packed_over_several_buckets(spark):
    n = S.BUCKET_BITS * 2 + 5
    df = spark.range(n).select(F.col("id").alias("pos"), (F.col("id") % 32768 == 1).alias("sel"))
    packed = S.pack(df, F.col("sel"), "pos", n)
    assert [len(r["bits"]) for r in packed.orderBy("bucket").collect()] == [4096, 4096, 1]
    assert S.unpack(packed, n).where("sel").count() == 3
    none = S.pack(df, F.lit(False), "pos", n)
    assert S.packed_count(none).first()["count"] == 0
    assert S.packed_count(S.combine_packed("or", packed, none)).first()["count"] == 3
    assert S.packed_count(S.combine_packed("and", packed, none)).first()["count"] == 0


def test_mask_algebra(spark):
    df = spark.createDataFrame([(a, b) for a in (False, True) for b in (False, True)], "a boolean, b boolean")
    a, b = F.col("a"), F.col("b")
    rows = df.select("a", "b", *[S.combine(op, a, b).alias(op) for op in ("and", "or", "andnot", "xor")], S.invert(a).alias("not")).collect()
    for r in rows:
        x, y = r["a"], r["b"]
        assert (r["and"], r["or"], r["andnot"], r["xor"], r["not"]) == (x and y, x or y, x and not y, x != y, not x)
        assert r["not"] == (not x)
    with pytest.raises(ValueError):
        S.combine("nor", a, b)


def test_empty_masks(spark):
    df = frame(spark, [True]).where("pos < 0")
    row = df.agg(S.popcount(F.col("sel")), S.all_selected(F.col("sel")), S.any_selected(F.col("sel")), S.none_selected(F.col("sel"))).first()
    assert tuple(row) == (0, True, False, True)
    assert (S.bitmap_bytes(0), S.bitmap_bytes(1), S.bitmap_bytes(8), S.bitmap_bytes(9)) == (0, 1, 1, 2)


@pytest.mark.parametrize("n", [1, 7, 8, 9, 70, 32768 * 2 + 3])
def test_packed_algebra(spark, n):
    df = spark.range(n).select(F.col("id").alias("pos"), (F.col("id") * 7 % 5 < 2).alias("a"), (F.col("id") % 3 == 1).alias("b"))
    a, b = (S.pack(df, F.col(c), "pos", n) for c in "ab")
    bits = lambda packed: {r["bucket"]: bytes(r["bits"]) for r in packed.collect()}
    for op in ("and", "or", "andnot", "xor"):
        assert bits(S.combine_packed(op, a, b)) == bits(S.pack(df, S.combine(op, F.col("a"), F.col("b")), "pos", n)), op
    assert bits(S.invert_packed(a, n)) == bits(S.pack(df, ~F.col("a"), "pos", n))
    with pytest.raises(ValueError):
        S.combine_packed("nor", a, b)


def test_ordinals_with_clashing_names(spark):
    df = spark.range(30).selectExpr("id as pos", "1 as __run", "2 as __at", "3 as __start")
    out = S.numbered(df.where("pos % 2 = 0"), "pos")
    assert out.columns == [*df.columns, "ord"] and [r["ord"] for r in out.orderBy("pos").collect()] == list(range(15))
