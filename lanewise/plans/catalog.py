"""Queries over the test tables, one or more for each operator, and the same in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.kinds import F64, I32, I64
from ..functions.predicates import compare
from ..functions.reductions import maximum, minimum, sum_wrapping
from ..operators.selection import keep_selected
from ..sources.tables import table
from . import arith_queries, compare_queries, gather_queries, reduce_queries, selection_queries
from ._base import Catalog

_catalog = Catalog()


def _sum_gt(spark, d, least: float = 24):
    """Compare, select and sum in one pass over two columns."""
    rows = table(spark, d, "lineitem").where(compare("gt", F.col("l_quantity"), least, F64))
    return rows.agg(sum_wrapping(F.col("l_partkey"), I64).alias("total"))


def _filtered(spark, d):
    """Compare, compact and reduce in one pass; ordinals are for results that return them."""
    chosen = keep_selected(table(spark, d, "orders"), compare("ge", F.col("o_totalprice"), 1000.0, F64))
    return chosen.agg(F.count(F.lit(1)).alias("n"), sum_wrapping(F.col("o_custkey"), I64).alias("total"))


def _nullable(spark, d):
    rows = table(spark, d, "orders").select(F.expr("nullif(o_custkey % 11, 0)").cast("int").alias("a"), F.expr("nullif(o_orderkey % 7, 0)").cast("int").alias("b"))
    live = F.col("a").isNotNull() & F.col("b").isNotNull()
    hit = live & compare("gt", F.col("a"), 4, I32)
    return rows.agg(F.count_if(hit).alias("hits"), minimum(F.col("b"), I32, live).cast("bigint").alias("lowest"), maximum(F.col("b"), I32, live).cast("bigint").alias("highest"))


_catalog.add("pipeline_sum_gt", _sum_gt, "SELECT coalesce(sum(l_partkey), 0)::BIGINT AS total FROM lineitem WHERE l_quantity > 24")
_catalog.add("pipeline_filter", _filtered, "SELECT count(*) AS n, coalesce(sum(o_custkey), 0)::BIGINT AS total FROM orders WHERE o_totalprice >= 1000")
_catalog.add("pipeline_nullable", _nullable, "SELECT count(*) FILTER (WHERE a > 4) AS hits, min(b)::BIGINT AS lowest, max(b)::BIGINT AS highest FROM (SELECT nullif(o_custkey % 11, 0) AS a, nullif(o_orderkey % 7, 0) AS b FROM orders) WHERE a IS NOT NULL AND b IS NOT NULL")
for _family in (compare_queries, selection_queries, gather_queries, reduce_queries, arith_queries):
    _family.register(_catalog)

QUERIES = _catalog.queries
SQL = _catalog.sql
