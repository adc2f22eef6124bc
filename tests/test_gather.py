import random

import pytest
from model import pack as packed_by_model
from pyspark.sql import functions as F

from lanewise.functions.kinds import I32, U8, U16, U32, U64
from lanewise.operators.bitpack import pack, unpack
from lanewise.operators.gather import dict_decode, take, take_from_array


def test_take_in_any_order(spark):
    values = spark.createDataFrame([(i, 10 + i) for i in range(5)], "pos long, value long")
    wanted = [2, 2, 2, 0, 4, 4, 1]
    indices = spark.createDataFrame(list(enumerate(wanted)), "ord long, idx long")
    assert [r["value"] for r in take(indices, values).orderBy("ord").collect()] == [10 + i for i in wanted]


def test_out_of_range_raises_and_null_stays(spark):
    values = spark.createDataFrame([(0, 1), (1, None)], "pos long, value long")
    one = spark.createDataFrame([(0, 1)], "ord long, idx long")
    assert take(one, values).first()["value"] is None
    for idx in (2, -1, None):
        with pytest.raises(Exception, match="out of range"):
            take(spark.createDataFrame([(0, idx)], "ord long, idx long"), values).collect()
    with pytest.raises(Exception, match="out of range"):
        spark.range(1).select(take_from_array(F.array(F.lit(1)), F.lit(1))).collect()


def test_decode_reads_selected_codes_only(spark):
    dictionary = spark.createDataFrame([(0, 100), (1, 200), (2, 300)], "code int, value long")
    facts = spark.createDataFrame([(i, c, i in (1, 4, 5)) for i, c in enumerate([99, 1, 99, 99, 0, 2])], "pos long, c int, sel boolean")
    out = dict_decode(facts, dictionary, "c", selection=F.col("sel")).orderBy("pos").collect()
    assert [r["value"] for r in out] == [200, 100, 300]
    assert dict_decode(facts, dictionary, "c", selection=F.lit(False)).count() == 0
    with pytest.raises(Exception, match="out of range"):
        dict_decode(facts, dictionary, "c").collect()


@pytest.mark.parametrize("kind", [U8, U16, U32, U64], ids=lambda k: k.name)
def test_unpack_every_width(spark, kind):
    random.seed(kind.bits)
    n = 37
    rows, columns = [], []
    for width in range(kind.bits + 1):
        values = [random.getrandbits(width) if width else 0 for _ in range(n)]
        rows.append((width, bytearray(packed_by_model(values, width)), values))
    one = spark.createDataFrame([tuple(b for _, b, _ in rows)], ", ".join(f"b{w} binary" for w, _, _ in rows))
    for first in range(0, len(rows), 11):
        columns = [unpack(f"b{w}", n, w, kind).alias(f"v{w}") for w, _, _ in rows[first : first + 11]]
        got = one.select(*columns).first()
        for width, _, values in rows[first : first + 11]:
            assert [int(x) for x in got[f"v{width}"]] == values, width


def test_frame_of_reference(spark):
    df = spark.createDataFrame([(bytearray(b"\xd1\x0b"), bytearray(b"\xf1"), bytearray(b"\xff" * 8))], "a binary, b binary, c binary")
    row = df.select(unpack("a", 4, 3, U8), unpack("a", 3, 0, U32, 77), unpack("b", 2, 4, U8, 250), unpack("c", 1, 64, U64, 1), unpack("a", 0, 3, U8)).first()
    assert [list(map(int, x)) for x in row] == [[1, 2, 7, 5], [77, 77, 77], [251, 9], [0], []]
    with pytest.raises(Exception, match="too short"):
        df.select(unpack("b", 3, 4, U8)).collect()
    with pytest.raises(ValueError):
        unpack("a", 1, 9, U8)
    with pytest.raises(ValueError):
        unpack("a", 1, 3, I32)


@pytest.mark.parametrize("width", [1, 3, 6, 8, 13, 31, 63])
def test_pack_round_trip(spark, width):
    random.seed(width)
    values = [random.getrandbits(width) for _ in range(21)]
    df = spark.createDataFrame([(values,), ([],)], "vs array<long>")
    rows = df.select(pack("vs", width).alias("b")).collect()
    assert bytes(rows[0]["b"]) == packed_by_model(values, width)
    assert bytes(rows[1]["b"]) == b""


def test_unpack_with_count_width_and_base_in_columns(spark):
    from lanewise.operators.bitpack import unpack_by

    random.seed(9)
    rows, expected = [], {}
    for i, width in enumerate([0, 1, 3, 7, 24, 33, 61, 62, 63, 64, 5]):
        n = 0 if i == 10 else random.randrange(1, 30)
        values = [random.getrandbits(width) if width else 0 for _ in range(n)]
        base = random.getrandbits(64)
        rows.append((i, n, width, str(base), bytearray(packed_by_model(values, width))))
        expected[i] = [(v + base) % (1 << 64) for v in values]
    df = spark.createDataFrame(rows, "id long, n int, w int, base string, bits binary").repartition(3).withColumn("base", F.col("base").cast("decimal(20,0)"))
    got = {r["id"]: [int(x) for x in r["v"]] for r in df.select("id", unpack_by("bits", "n", "w", U64, "base").alias("v")).collect()}
    assert got == expected
    narrow = spark.createDataFrame([(4, 3, 250, bytearray(b"\xd1\x0b")), (None, 3, 0, bytearray(b"")), (2, 3, 0, None)], "n int, w int, base int, bits binary")
    assert [r["v"] for r in narrow.select(unpack_by("bits", "n", "w", U8, "base").alias("v")).collect()] == [[251, 252, 1, 255], None, None]
    with pytest.raises(Exception, match="too short"):
        spark.createDataFrame([(9, 3, bytearray(b"\x01"))], "n int, w int, bits binary").select(unpack_by("bits", "n", "w", U8)).collect()
    with pytest.raises(Exception, match="width isn't within"):
        spark.createDataFrame([(1, 9, bytearray(b"\x01\x02"))], "n int, w int, bits binary").select(unpack_by("bits", "n", "w", U8)).collect()


@pytest.mark.parametrize("most", [64 << 20, 0])
def test_dictionary_joined_either_way_and_clashing_names(spark, monkeypatch, most):
    from lanewise.operators import gather

    monkeypatch.setattr(gather, "MOST_BROADCAST", most)
    dictionary = spark.range(50).selectExpr("id as code", "repeat('x', cast(id as int)) as value")
    facts = spark.range(200).selectExpr("id", "id % 50 as c", "1 as __hit", "2 as __key", "3 as __value")
    out = dict_decode(facts, dictionary, "c")
    assert out.columns == ["id", "c", "__hit", "__key", "__value", "value"]
    assert all(len(r["value"]) == r["c"] and (r["__hit"], r["__key"], r["__value"]) == (1, 2, 3) for r in out.collect())
