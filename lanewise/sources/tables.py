"""Reading tables with row positions, and writing results.

Rows of a DataFrame have no order. Operators for which order matters take a position column; ``positioned`` makes one for tables
that have no dense key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table of a folder."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def positioned(spark: SparkSession, path: str, pos: str = "pos") -> DataFrame:
    """A Parquet table with ``pos``: 0 to n - 1 by file path and row of the file. Only one count for each file meets in one place."""
    rows = spark.read.parquet(path)
    placed = rows.select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.row_index").alias("__row"))
    sizes = placed.groupBy("__file").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__file").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    starts = sizes.select("__file", (F.sum("__n").over(before) - F.col("__n")).alias("__start"))
    return placed.join(starts, "__file").select(*rows.columns, (F.col("__start") + F.col("__row")).alias(pos))


def write(rows: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Writes a result as Parquet."""
    rows.write.mode(mode).parquet(path)
