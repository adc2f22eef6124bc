"""Common parts of the query catalogue."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]

#: Events with NaN, -0.0 and null among their values; the same text in both engines.
ODD_VALUE = "case when event_id % 11 = 0 then cast('NaN' as double) when event_id % 13 = 0 then cast('-0.0' as double) when event_id % 17 = 0 then null else value end"
NULLABLE_SIZE = "nullif(p_size % 10, 0)"
NULLABLE_A, NULLABLE_B = "nullif(o_custkey % 11, 0)", "nullif(o_orderkey % 7, 0)"


class Catalog:
    """Queries by name, and their SQL."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.sql: dict[str, str] = {}

    def add(self, name: str, query: Query, sql: str) -> None:
        self.queries[name] = query
        self.sql[name] = sql


def parts(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part").select(F.col("p_partkey").alias("pos"), F.expr(NULLABLE_SIZE).alias("x"), "p_size")


def pairs(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").select(F.col("o_orderkey").alias("pos"), F.expr(NULLABLE_A).alias("a"), F.expr(NULLABLE_B).alias("b"))


def odd_events(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select(F.col("event_id").alias("pos"), F.expr(ODD_VALUE).alias("v"))


PARTS = f"(SELECT p_partkey AS pos, {NULLABLE_SIZE} AS x, p_size FROM part)"
PAIRS = f"(SELECT o_orderkey AS pos, {NULLABLE_A} AS a, {NULLABLE_B} AS b FROM orders)"
ODD_EVENTS = f"(SELECT event_id AS pos, {ODD_VALUE} AS v FROM events)"
SIGNS = {"eq": "=", "ne": "<>", "lt": "<", "le": "<=", "gt": ">", "ge": ">="}
