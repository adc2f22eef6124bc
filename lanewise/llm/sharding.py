"""Two-pass external shuffle into shards of equal row counts, with DataFrame functions only.

Pass one scatters records uniformly over buckets that fit in memory: each record draws a seeded hash of its place in the input, so
that a hot source, a group of copies and even rows alike in all columns spread over all buckets. The drawn numbers are written
with the records in the shared folder before anything is counted, so the rest stays the same if an executor is lost. Pass two
gathers one bucket at a time, shuffles it with Fisher-Yates (Spark's ``shuffle``, on an array sorted beforehand) and lays the
buckets end to end. The sequence is a seeded random permutation of the records; shard s is its s-th equal run (law ``rows``: counts
at most one apart). ``write_shards`` writes a folder for each shard, its files and their rows in order of slots.

The number of buckets follows the bytes of the records, all columns counted. Offsets come from the bucket counts, one small row per
bucket, read from the drawn numbers alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._store import written

#: Least and most bytes that a bucket is meant to hold; between them, the input is dealt into BUCKETS of equal size.
BUCKET_BYTES = (2 << 20, 128 << 20)
BUCKETS = 2000
#: Buckets up to which their offsets are broadcast (about 12 MB); beyond, they are joined by a shuffle.
MOST_BROADCAST = 500_000
#: Bytes counted for each record besides its text.
ROW_BYTES = 8
#: Rows of a file that ``write_shards`` writes.
ROWS_PER_FILE = 1_000_000


def record_size(text: str) -> Column:
    """UTF-8 bytes of the text (null: none) plus ROW_BYTES, as a long."""
    return F.coalesce(F.octet_length(F.col(f"`{text}`")), F.lit(0)).cast("long") + F.lit(ROW_BYTES)


def _row_size(schema: T.StructType) -> Column:
    """About the bytes of a row: those of its strings and binaries, those of nested values written out, 8 for each column besides."""
    total = F.lit(8 * len(schema)).cast("long")
    for field in schema:
        if isinstance(field.dataType, (T.StringType, T.BinaryType)):
            total = total + F.coalesce(F.octet_length(F.col(f"`{field.name}`")), F.lit(0))
        elif isinstance(field.dataType, (T.ArrayType, T.MapType, T.StructType)):
            total = total + F.coalesce(F.octet_length(F.col(f"`{field.name}`").cast("string")), F.lit(0))
    return total


def _placed(docs: DataFrame, shards: int, seed: int, bucket_bytes: tuple[int, int]) -> tuple[DataFrame, int]:
    """The rows with their shard and slot, and how many they are."""
    if shards < 1:
        raise ValueError("shards must be at least 1")
    docs = docs.drop("shard", "slot")
    void = [f.name for f in docs.schema if isinstance(f.dataType, T.NullType)]  # no file holds these
    kept = [f.name for f in docs.schema if f.name not in void]
    drawn = F.xxhash64(F.lit(seed), F.monotonically_increasing_id())
    row = F.struct(F.lit(0).alias("none"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)])
    scattered = written(docs.select(drawn.alias("drawn"), _row_size(docs.schema).alias("size"), row.alias("row")), "scattered", "zstd")
    whole = scattered.agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")).first()
    rows, total = whole["rows"], whole["bytes"] or 0
    each = min(bucket_bytes[1], max(bucket_bytes[0], total // BUCKETS))
    buckets = max(1, -(-total // each))
    bucketed = scattered.select("drawn", "row", F.pmod("drawn", F.lit(buckets)).cast("int").alias("bucket"))
    counts = bucketed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    running = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    offsets = counts.select("bucket", (F.sum("n").over(running) - F.col("n")).alias("before"))
    shuffled = (
        bucketed.repartitionById(buckets, "bucket")
        .groupBy("bucket")
        .agg(F.collect_list(F.struct("drawn", "row")).alias("all"))
        .select("bucket", F.shuffle(F.array_sort("all", _by_drawn), seed).alias("all"))
    )
    # A row of two numbers for each bucket; their number is known here.
    placed = shuffled.join(F.broadcast(offsets) if buckets <= MOST_BROADCAST else offsets, "bucket").select("before", F.posexplode("all").alias("at", "item"))
    placed = placed.select(F.col("item.row").alias("row"), (F.col("before") + F.col("at")).alias("at"))
    shard = f"((at + 1) * {shards} - 1) div {max(rows, 1)}"
    columns = [F.lit(None).alias(c) if c in void else F.col(f"row.c{kept.index(c)}").alias(c) for c in docs.columns]
    return placed.select(*columns, F.expr(shard).cast("int").alias("shard"), F.expr(f"at - ({shard}) * {rows} div {shards}").cast("long").alias("slot")), rows


def shuffle_into_shards(docs: DataFrame, shards: int = 24, seed: int = 20240607, bucket_bytes: tuple[int, int] = BUCKET_BYTES) -> DataFrame:
    """All rows and columns of ``docs`` with ``shard`` (int, 0 to shards - 1) and ``slot`` (long, gapless from 0 in a shard).

    The same input in the same partitions gets the same order. Nulls in any column are kept; rows that are alike are all kept, each
    with its own slot, and don't share a bucket; an empty table gives an empty table. A row that is larger than a bucket makes its
    bucket that much larger. Columns of docs named shard or slot are replaced; others may have any names. With fewer rows than
    shards, some shards are empty. The rows are copied to the shared folder first.
    """
    return _placed(docs, shards, seed, bucket_bytes)[0]


def write_shards(
    docs: DataFrame, path: str, shards: int = 24, seed: int = 20240607, bucket_bytes: tuple[int, int] = BUCKET_BYTES, rows_per_file: int = ROWS_PER_FILE
) -> None:
    """Writes ``docs`` into folders ``shard=0``, ``shard=1``, ... of Parquet files, which hold the shard's slots in order of file names.

    A file has at most ``rows_per_file`` rows and is made by one task. Rows and columns are those of ``shuffle_into_shards``; an
    empty shard has no folder.
    """
    placed, rows = _placed(docs, shards, seed, bucket_bytes)
    files = max(1, -(-rows // (shards * rows_per_file)) + 1)
    file = F.col("shard") * files + F.expr(f"cast(slot div {rows_per_file} as int)")
    placed.repartitionById(shards * files, file).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def _by_drawn(a: Column, b: Column) -> Column:
    return F.when(a["drawn"] < b["drawn"], -1).when(a["drawn"] > b["drawn"], 1).otherwise(0)
