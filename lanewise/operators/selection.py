"""Selections of rows: compaction, conversion between boolean and list form, mask algebra, and packed bitmaps.

A selection is a boolean column without nulls beside a position column ``pos`` (0 to n - 1), or a table (ord, idx) of the selected
positions in rising order. Packed bitmaps are a boundary format: rows (bucket, bits) of up to 4096 bytes, bit i of a bucket standing
for position 32768 * bucket + i, least significant bit first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.kinds import MASK_OPS
from ..functions.names import free

BUCKET_BITS = 32768
#: Positions that are numbered together when ordinals are given out.
RUN = 1 << 20


def numbered(rows: DataFrame, pos: str, ordinal: str = "ord") -> DataFrame:
    """``rows`` with ``ordinal``: 0, 1, 2, ... in order of ``pos``.

    Positions are cut into runs of RUN; each run is numbered on its own and begins where the counts of those before it end, so
    the whole table is never sorted in one task. Only one count for each run meets in one place.
    """
    in_run, at, start = (free([*rows.columns, ordinal], stem) for stem in ("run", "at", "start"))
    run = F.expr(f"`{pos}` div {RUN}")
    counted = rows.groupBy(run.alias(in_run)).agg(F.count(F.lit(1)).alias(at))
    before = Window.orderBy(in_run).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    starts = counted.select(in_run, (F.sum(at).over(before) - F.col(at)).alias(start))
    inner = Window.partitionBy(in_run).orderBy(pos)
    within = rows.withColumn(in_run, run).withColumn(at, F.row_number().over(inner) - 1)
    return within.join(starts, in_run).withColumn(ordinal, (F.col(start) + F.col(at)).cast("bigint")).drop(in_run, at, start)


def keep_selected(rows: DataFrame, selection: Column, pos: str | None = None, ordinal: str | None = None) -> DataFrame:
    """The selected rows, in no less order than they had; validity of other columns isn't consulted. With ``ordinal`` they are numbered."""
    kept = rows.where(selection)
    return kept if ordinal is None else numbered(kept, pos, ordinal)


def keep_listed(rows: DataFrame, listed: DataFrame, pos: str, idx: str = "idx") -> DataFrame:
    """Rows whose ``pos`` is listed, with the columns of ``listed``, such as its ordinal. An empty list keeps nothing."""
    return listed.join(rows, listed[idx] == rows[pos])


def positions(rows: DataFrame, selection: Column, pos: str, ordinal: str | None = "ord") -> DataFrame:
    """The selected positions as ``idx``, with ``ord`` unless it isn't asked for."""
    kept = rows.where(selection).select(F.col(pos).cast("bigint").alias("idx"))
    return kept if ordinal is None else numbered(kept, "idx", ordinal)


def from_positions(listed: DataFrame, rows: int, idx: str = "idx") -> DataFrame:
    """(pos, sel) for all positions below ``rows``: true for exactly the listed ones."""
    marks = listed.select(F.col(idx).alias("pos"), F.lit(True).alias("__sel"))
    everything = listed.sparkSession.range(rows).withColumnRenamed("id", "pos")
    return everything.join(marks, "pos", "left").select("pos", F.coalesce("__sel", F.lit(False)).alias("sel"))


def combine(op: str, a: Column, b: Column) -> Column:
    """Mask algebra on boolean columns without nulls; op is one of MASK_OPS."""
    if op not in MASK_OPS:
        raise ValueError(f"unknown mask operation {op!r}")
    return {"and": lambda: a & b, "or": lambda: a | b, "andnot": lambda: a & ~b, "xor": lambda: a != b}[op]()


def invert(a: Column) -> Column:
    return ~a


def popcount(a: Column) -> Column:
    """Aggregate: how many are selected."""
    return F.count_if(a)


def all_selected(a: Column) -> Column:
    """Aggregate; true for no rows."""
    return F.coalesce(F.every(a), F.lit(True))


def any_selected(a: Column) -> Column:
    """Aggregate; false for no rows."""
    return F.coalesce(F.some(a), F.lit(False))


def none_selected(a: Column) -> Column:
    """Aggregate; true for no rows."""
    return ~any_selected(a)


def bitmap_bytes(n: int) -> int:
    """Bytes of a packed bitmap of n rows."""
    return -(-n // 8)


def pack(rows: DataFrame, selection: Column, pos: str, n: int) -> DataFrame:
    """(bucket, bits) of a selection of n rows. The last bucket has as many bytes as it needs, bits beyond n are zero."""
    spark = rows.sparkSession
    bit = F.col(pos).cast("bigint") + 1
    made = rows.where(selection).groupBy((F.bitmap_bucket_number(bit) - 1).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("__bits"))
    buckets = spark.range(-(-n // BUCKET_BITS)).withColumnRenamed("id", "bucket")
    zeros = F.unhex(F.repeat(F.lit("00"), F.lit(BUCKET_BITS // 8)))
    size = F.least(F.lit(BUCKET_BITS // 8).cast("bigint"), F.lit(bitmap_bytes(n)).cast("bigint") - F.col("bucket") * (BUCKET_BITS // 8)).cast("int")
    return buckets.join(made, "bucket", "left").select("bucket", F.substring(F.coalesce("__bits", zeros), F.lit(1), size).alias("bits"))


def unpack(packed: DataFrame, n: int) -> DataFrame:
    """(pos, sel) for the n rows of a packed bitmap; bits beyond n are ignored."""
    byte = F.posexplode(F.expr("transform(sequence(1, greatest(length(bits), 1)), i -> cast(conv(hex(substring(bits, i, 1)), 16, 10) as int))"))
    octets = packed.where("length(bits) > 0").select("bucket", byte.alias("__byte", "__value"))
    bits = octets.select("bucket", "__byte", "__value", F.explode(F.expr("sequence(0, 7)")).alias("__bit"))
    pos = F.col("bucket") * BUCKET_BITS + F.col("__byte") * 8 + F.col("__bit")
    return bits.select(pos.cast("bigint").alias("pos"), (F.expr("shiftright(__value, __bit) & 1") == 1).alias("sel")).where(F.col("pos") < n)


def _merged(op: str, a: DataFrame, b: DataFrame) -> DataFrame:
    merge = {"and": F.bitmap_and_agg, "or": F.bitmap_or_agg}[op]
    sizes = a.select("bucket", F.length("bits").alias("__size"))
    wide = lambda x: x.select("bucket", F.rpad(F.hex("bits"), BUCKET_BITS // 4, "0").alias("__hex"))
    both = wide(a).unionAll(wide(b)).groupBy("bucket").agg(merge(F.unhex("__hex")).alias("__bits"))
    return both.join(sizes, "bucket").select("bucket", F.substring(F.col("__bits"), F.lit(1), F.col("__size")).alias("bits"))


def _flipped(packed: DataFrame) -> DataFrame:
    """All bits inverted, those of the tail too: a hexadecimal digit's complement is the digit as far from F as it is from 0."""
    digits = "0123456789ABCDEF"
    return packed.select("bucket", F.unhex(F.translate(F.hex("bits"), digits, digits[::-1])).alias("bits"))


def combine_packed(op: str, a: DataFrame, b: DataFrame) -> DataFrame:
    """Mask algebra of two packed bitmaps of the same number of rows, bucket by bucket; tails of zeros stay so. op is one of MASK_OPS."""
    if op not in MASK_OPS:
        raise ValueError(f"unknown mask operation {op!r}")
    if op == "andnot":
        return _merged("and", a, _flipped(b))
    if op == "xor":
        return _merged("and", _merged("or", a, b), _flipped(_merged("and", a, b)))
    return _merged(op, a, b)


def invert_packed(packed: DataFrame, n: int) -> DataFrame:
    """The inverse of a packed bitmap of n rows; bits beyond n stay zero."""
    size, last = F.length("bits"), F.col("bucket") == (n - 1) // BUCKET_BITS
    spare = n % 8
    end = F.conv(F.hex(F.substring(F.col("bits"), size, F.lit(1))), 16, 10).cast("int").bitwiseAND(F.lit((1 << (spare or 8)) - 1))
    cut = F.concat(F.substring(F.col("bits"), F.lit(1), size - 1), F.unhex(F.lpad(F.hex(end.cast("bigint")), 2, "0")))
    return _flipped(packed).select("bucket", F.when(last & (size > 0), cut).otherwise(F.col("bits")).alias("bits"))


def packed_count(packed: DataFrame) -> DataFrame:
    """One row with ``count``: the bits set in a packed bitmap whose tail is zero."""
    return packed.agg(F.coalesce(F.sum(F.bitmap_count("bits")), F.lit(0)).cast("bigint").alias("count"))
