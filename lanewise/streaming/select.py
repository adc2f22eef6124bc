"""The same column expressions on streams.

Predicates, arithmetic, hashes and integer reductions need no order and no state of their own, so they run unchanged in Structured
Streaming. Operators in order of positions (ordinals, strict float sums) are for batches only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import types as T


def parquet_stream(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A stream of the Parquet files that appear in a folder."""
    return spark.readStream.schema(schema).parquet(path)


def filtered(stream: DataFrame, selection: Column) -> DataFrame:
    """The selected rows of a stream."""
    return stream.where(selection)


def running(stream: DataFrame, **aggregates: Column) -> DataFrame:
    """Reductions over all rows of a stream so far; for the output modes complete and update."""
    return stream.groupBy().agg(*[a.alias(name) for name, a in aggregates.items()])
