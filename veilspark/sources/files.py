"""Reading and writing files."""

from __future__ import annotations

import re
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession, functions as F


#: Tasks that a core gets of a spread scan: short tasks even out and cost little when lost.
TASKS_PER_CORE = 4
#: Rows that a task gets at most of a spread scan, so that a task is as long for any input.
ROWS_PER_TASK = 50_000


def tasks(spark: SparkSession) -> int:
    """How many tasks computing on a few files is spread over."""
    return TASKS_PER_CORE * spark.sparkContext.defaultParallelism


def spread(scan: DataFrame, rows: int = ROWS_PER_TASK) -> DataFrame:
    """Spread a scan that has fewer partitions than a few for each core, or than one for so
    many rows.

    Detection is all computing, and a file of 128 MB is one partition and can hold millions
    of texts. Tables with more partitions are left as they are. For plain scans
    only: asking anything else for its partitions may run it. Rows are
    counted first, in a file by its footers.
    """
    n = max(tasks(scan.sparkSession), -(-scan.count() // rows))
    return scan.repartition(n) if scan.rdd.getNumPartitions() < n else scan


def read_texts(spark: SparkSession, path: str, fmt: str = "parquet", row_id: str = "id",
               text: str = "text", **options: str) -> DataFrame:
    """A table of texts as ``(id, text)``. Lines of plain text are keyed by their hash and
    file, since a running number would need one task to count."""
    if fmt == "text":
        lines = spark.read.options(**options).text(path)
        return lines.select(F.xxhash64("value", F.col("_metadata.file_path")).alias("id"),
                            F.col("value").alias("text"))
    rows = spark.read.options(**options).format(fmt).load(path)
    return rows.select(F.col(row_id).alias("id"), F.col(text).alias("text"))


def read_records(spark: SparkSession, path: str, schema: str, multiline: bool = False
                 ) -> DataFrame:
    """JSON records by a pinned schema, one object per line, split between tasks.

    ``multiline=True`` reads a file that is one list of objects, in one task.
    """
    return spark.read.schema(schema).option("multiLine", multiline).option(
        "mode", "FAILFAST").json(path)


def write_records(records: DataFrame, path: str, compression: str = "gzip") -> None:
    """Cleaned records as JSON, one object per line, UTF-8, nulls kept.

    As text a record takes many times the room of the row it comes from, so the files are
    compressed. A task reads a compressed file whole: there are as many as tasks wrote them.
    """
    records.write.mode("overwrite").option("ignoreNullFields", "false").option(
        "compression", compression).json(path)


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).csv(path)


def write_export(rows: DataFrame, summary: DataFrame, path: str) -> None:
    """An export as JSON lines: ``mappings`` in parts, and one line about it in ``summary``.

    The summary comes last, so an export that has one is whole. Rows are written as they
    are spread; nothing passes through one task but the summary's single row.
    """
    root = path.rstrip("/")
    write_records(rows, f"{root}/mappings", "none")
    summary.coalesce(1).write.mode("overwrite").option("ignoreNullFields", "false").json(
        f"{root}/summary")


def read_export(spark: SparkSession, path: str) -> DataFrame:
    """The lines of an export as written: (part, line)."""
    root = path.rstrip("/")
    part = lambda name: spark.read.text(f"{root}/{name}").select(
        F.lit(name).alias("part"), F.col("value").alias("line"))
    return part("summary").unionByName(part("mappings"))


def write_report(tables: dict[str, DataFrame], path: str) -> None:
    """A comparison report: each table as JSON lines in a folder of its name."""
    for name, rows in tables.items():
        write_records(rows, f"{path.rstrip('/')}/{name}", "none")


def read_report(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """The lines of a report's tables as written: (part, line)."""
    out = None
    for name in names:
        rows = spark.read.text(f"{path.rstrip('/')}/{name}").select(
            F.lit(name).alias("part"), F.col("value").alias("line"))
        out = rows if out is None else out.unionByName(rows)
    return out


def timespan(text: str) -> timedelta:
    """``30m``, ``24h`` or ``7d``."""
    found = re.fullmatch(r"(\d+)([mhd])", text.strip().lower())
    if not found:
        raise ValueError("a time span is a number and m, h or d")
    unit = {"m": "minutes", "h": "hours", "d": "days"}[found[2]]
    return timedelta(**{unit: int(found[1])})


def windowed_scan(rows: DataFrame, at: str, row_id: str, end: datetime, span: str, limit: int
                  ) -> DataFrame:
    """The latest ``limit`` rows of a time window. The bounds are plain literals on the
    column, so they reach the file scan; the order makes the limit repeatable."""
    low = F.lit(end - timespan(span)).cast("timestamp_ntz")
    high = F.lit(end).cast("timestamp_ntz")
    return rows.filter((F.col(at) > low) & (F.col(at) <= high)).orderBy(
        F.desc(at), row_id).limit(limit)
