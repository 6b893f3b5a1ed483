"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from veilspark.session import materialize


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def map_rows(df: DataFrame, step: Callable[[list[dict]], Iterator[dict]], schema: str,
             chars: int = 4_000_000, weigh: str | None = None) -> DataFrame:
    """Run ``step`` over groups of rows of about ``chars`` characters of column ``weigh``.

    A group is never split over a row, so a text longer than the bound is a group alone.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    target = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        for batch in batches:
            names = batch.schema.names
            group: list[dict] = []
            held = 0
            for at in range(0, batch.num_rows, 128):  # few rows at a time become Python's
                part = batch.slice(at, 128)
                for values in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    row = dict(zip(names, values, strict=True))
                    group.append(row)
                    held += len(row[weigh] or "") if weigh else 1
                    if held >= chars:
                        yield _record(step(group), target)
                        group, held = [], 0
            if group:
                yield _record(step(group), target)

    return df.mapInArrow(run, schema)


def _record(rows, target: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(list(rows), schema=target)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write rows with the number of the task that wrote them (column ``task``)."""
    return materialize(df.withColumn("task", F.spark_partition_id()), name)


def gapless(rows: DataFrame, keys: list[str], order: list[Column], out: str) -> DataFrame:
    """Number the rows of each key from 0 without gaps.

    ``rows`` comes from :func:`stored`. Rows are numbered inside (key, task), and the
    counts of the tasks before are added, so no task ever holds all rows of a key.
    """
    inside = Window.partitionBy(*keys, "task").orderBy(*order)
    before = Window.partitionBy(*keys).orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    counts = (
        rows.groupBy(*keys, "task").agg(F.count("*").alias("_n"))
        .select(*keys, "task", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    )
    return (
        rows.withColumn("_rank", F.row_number().over(inside))
        .join(counts, [*keys, "task"])
        .withColumn(out, F.col("_base") + F.col("_rank") - 1)
        .drop("_base", "_rank")
    )
