"""Sources, streams and the driver's entry points."""

from pyspark.sql import functions as F

from lanewise import version_string
from lanewise.functions.kinds import F64, I64
from lanewise.functions.predicates import compare
from lanewise.functions.reductions import count_valid, sum_wrapping
from lanewise.sources.tables import positioned, table, write
from lanewise.streaming.select import filtered, parquet_stream, running

FOLDER = "/root/testdata/sf0.001"


def test_positions_are_dense_over_files(spark, tmp_path):
    path = str(tmp_path / "t")
    write(spark.range(100).repartition(5), path)
    assert sorted(r["pos"] for r in positioned(spark, path).collect()) == list(range(100))


def test_stream_equals_batch(spark, tmp_path):
    batch = table(spark, FOLDER, "events")
    write(batch.repartition(3), str(tmp_path / "events"))
    stream = parquet_stream(spark, str(tmp_path / "events"), batch.schema)
    hot = compare("gt", F.col("value"), 100.0, F64)
    reductions = {"n": count_valid(F.col("event_id")), "total": sum_wrapping(F.col("event_id"), I64)}
    query = running(filtered(stream, hot), **reductions).writeStream.outputMode("complete").format("memory").queryName("sums").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("sums").collect() == batch.where(hot).agg(*[v.alias(k) for k, v in reductions.items()]).collect()


def test_entry(spark):
    import __spark_entry__ as driver

    assert driver.entry(spark).columns == ["total"]
    assert driver.entry(spark).count() == 1
    assert set(driver.oracle_sql()) <= set(driver.queries())
    assert version_string() == "0.1.0"


def test_flagship_reads_two_columns_and_pushes_its_filter(spark):
    from lanewise.plans.catalog import QUERIES

    plan = QUERIES["pipeline_sum_gt"](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<l_partkey:bigint,l_quantity:double>" in plan
    assert "GreaterThan(l_quantity,24.0)" in plan
