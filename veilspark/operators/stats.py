"""Statistics over the mapping table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

TOP = 100


def overall(store: DataFrame) -> DataFrame:
    """One row, zeros when the table is empty."""
    return store.agg(
        F.count("*").alias("total_mappings"),
        F.coalesce(F.sum("substitution_count"), F.lit(0)).alias("total_substitutions"),
        F.min("first_seen").alias("oldest_mapping"),
        F.max("first_seen").alias("newest_mapping"))


def _totals() -> list[Column]:
    return [F.count("*").alias("unique_values"),
            F.coalesce(F.sum("substitution_count"), F.lit(0)).alias("total_substitutions")]


def by_type(store: DataFrame) -> DataFrame:
    return store.groupBy("entity_type").agg(*_totals())


def one_type(store: DataFrame, entity_type: str) -> DataFrame:
    """Totals of one type; no row when it has no mapping."""
    return store.filter(F.col("entity_type") == entity_type).groupBy("entity_type").agg(*_totals())


def top_substitutes(store: DataFrame, entity_type: str, n: int = TOP) -> DataFrame:
    """Most used substitutes of a type: a top-k, no full sort."""
    return (
        store.filter(F.col("entity_type") == entity_type)
        .orderBy(F.desc("substitution_count"), "original_hash").limit(n)
        .select("entity_type", "substitute", F.col("substitution_count").alias("count"),
                "first_seen")
    )


def top_by_type(store: DataFrame, n: int = TOP) -> DataFrame:
    """The same for all types at once. Spark limits each task to ``n`` rows per type
    before the shuffle (WindowGroupLimit), so a type with most rows is no hot spot."""
    order = Window.partitionBy("entity_type").orderBy(F.desc("substitution_count"),
                                                      "original_hash")
    return (
        store.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= n)
        .select("entity_type", F.col("place").cast("bigint").alias("place"), "substitute",
                F.col("substitution_count").alias("count"))
    )


def distribution(store: DataFrame) -> DataFrame:
    """Share of all substitutions in percent and average uses per value, one decimal.

    Works on one row per type, so the window without a key sees at most twenty.
    """
    total = F.sum("total_substitutions").over(Window.partitionBy(F.lit(1)))
    uses, values = F.col("total_substitutions"), F.col("unique_values")
    return by_type(store).select(
        "entity_type", "unique_values", "total_substitutions",
        F.round(F.when(total > 0, 100 * uses / total).otherwise(0.0), 1).alias("share"),
        F.round(F.when(values > 0, uses / values).otherwise(0.0), 1).alias("average_uses"))


def export_table(store: DataFrame) -> DataFrame:
    """By type with a TOTAL row last."""
    types = by_type(store).withColumn("last", F.lit(0))
    total = types.agg(
        F.lit("TOTAL").alias("entity_type"),
        F.coalesce(F.sum("unique_values"), F.lit(0)).alias("unique_values"),
        F.coalesce(F.sum("total_substitutions"), F.lit(0)).alias("total_substitutions"),
        F.lit(1).alias("last"))
    return types.unionByName(total).orderBy("last", "entity_type").drop("last")
