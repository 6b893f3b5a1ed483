"""Joins that hold when one key has a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 64_000_000
SALTS = 32
HOT_SHARE = 0.005


def _bytes(field: T.StructField) -> Column:
    """About the bytes of a value: exact for texts, as JSON for what is nested."""
    value = F.col(f"`{field.name}`")
    if isinstance(field.dataType, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(value), F.lit(0))
    if isinstance(field.dataType, (T.ArrayType, T.StructType, T.MapType)):
        return F.coalesce(F.octet_length(F.to_json(value)), F.lit(0))
    return F.lit(8)


def is_small(df: DataFrame, rows: int = BROADCAST_ROWS, most_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether a table has at most ``rows`` rows and ``most_bytes`` bytes; reads no more than
    one row above."""
    size = sum((_bytes(f) for f in df.schema.fields), F.lit(0))
    n, total = df.limit(rows + 1).agg(F.count("*"), F.sum(size)).head()
    return n <= rows and (total or 0) <= most_bytes


def hot_keys(df: DataFrame, key: str, share: float = HOT_SHARE) -> DataFrame:
    """Keys with more than ``share`` of the rows: at most ``1 / share`` of them.

    Counts are partial before the shuffle, so a hot key costs one row per task.
    """
    counts = df.groupBy(key).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    return counts.filter(F.col("n") > total * share).select(key)


def keyed_join(big: DataFrame, small: DataFrame, key: str, row_id: str, how: str = "inner",
               small_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Join many rows to a table with one row per key.

    Broadcast when the table is shown to be small. Otherwise both sides are
    shuffled, and the rows of a hot key are spread over ``SALTS`` tasks by their
    row id (the same on a retry) while its single table row is repeated as often.
    """
    if how not in ("inner", "left"):
        raise ValueError("how must be inner or left")
    if is_small(small, small_rows):
        return big.join(F.broadcast(small), key, how)
    hot = hot_keys(big, key).withColumn("hot", F.lit(True))
    salted_big = big.join(F.broadcast(hot), key, "left").withColumn(
        "salt", F.when(F.col("hot"), F.pmod(F.xxhash64(row_id), F.lit(SALTS))).otherwise(0)
    ).drop("hot")
    salted_small = small.join(F.broadcast(hot), key, "left").withColumn(
        "salt",
        F.explode(F.sequence(F.lit(0).cast("bigint"),
                             F.when(F.col("hot"), SALTS - 1).otherwise(0).cast("bigint"))),
    ).drop("hot")
    return salted_big.join(salted_small, [key, "salt"], how).drop("salt")
