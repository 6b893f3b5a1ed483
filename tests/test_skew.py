"""What counts as small, and joins on both sides of it."""

from pyspark.sql import functions as F

from veilspark.operators.skew import is_small, keyed_join


def test_small_by_rows_and_by_bytes(spark):
    rows = spark.range(100).select("id", F.repeat(F.lit("é"), 1000).alias("t"), F.array(F.lit("x" * 50)).alias("a"))
    assert is_small(rows) and is_small(rows, 100) and not is_small(rows, 99)
    assert is_small(rows, 100, 250_000) and not is_small(rows, 100, 200_000)
    assert is_small(rows.limit(0)) and is_small(spark.createDataFrame([(None, None)], "s string, m map<string,int>"))


def test_joins_of_all_sizes_agree(spark):
    big = spark.range(5000).select("id", F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 50).alias("k"))
    small = spark.range(40).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    for how in ("inner", "left"):
        one, two = (sorted((r["id"], r["k"], r["v"] or -1) for r in keyed_join(big, small, "k", "id", how, n).collect())
                    for n in (1000, 10))
        assert one == two and len(one) == (5000 if how == "left" else big.filter("k < 40").count())


def test_scans_and_streams_are_spread_over_all_cores(spark, tmp_path):
    """One file is one partition; computing on it is not one task."""
    from veilspark.sources.files import spread, tasks
    from veilspark.streaming.incremental import stream_table

    spark.range(1000).selectExpr("id", "'x' as text").coalesce(1).write.parquet(f"{tmp_path}/in")
    assert spread(spark.read.parquet(f"{tmp_path}/in")).rdd.getNumPartitions() == tasks(spark)
    assert tasks(spark) > spark.sparkContext.defaultParallelism
    seen = []
    stream_table(spark, f"{tmp_path}/in", spark.read.parquet(f"{tmp_path}/in").schema).writeStream.foreachBatch(
        lambda batch, n: seen.append(batch.select(F.spark_partition_id()).distinct().count())
    ).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    assert max(seen) == tasks(spark)


def test_tasks_of_a_spread_scan_grow_with_its_rows(spark, tmp_path):
    """The longest task is as long for a large table as for a small one."""
    from veilspark.sources.files import spread, tasks

    spark.range(1000).selectExpr("id", "'x' as text").coalesce(1).write.parquet(f"{tmp_path}/in")
    n = tasks(spark)
    wide = spread(spark.read.parquet(f"{tmp_path}/in"), rows=1000 // (2 * n))
    assert wide.rdd.getNumPartitions() >= 2 * n
    assert sorted(r["id"] for r in wide.collect()) == list(range(1000))
    assert spread(spark.read.parquet(f"{tmp_path}/in").limit(0), rows=10).count() == 0
