"""Lists a user chooses from."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.patterns import ENTITY_TYPES, TYPE_RANK
from ..functions.pools import LOCALES


def entity_types(spans: DataFrame) -> DataFrame:
    """Supported types with description and rank, beside the spans found of each."""
    rows = [(t, d, TYPE_RANK[t]) for t, d in ENTITY_TYPES.items()]
    listed = spans.sparkSession.createDataFrame(rows, "name string, description string, rank int")
    found = spans.groupBy(F.col("entity_type").alias("name")).agg(F.count("*").alias("hits"))
    return listed.join(found, "name", "left").fillna(0, ["hits"])


def locales(customers: DataFrame) -> DataFrame:
    """Supported locales in order, each with the customers of the nation of that number."""
    spark = customers.sparkSession
    listed = spark.createDataFrame(
        [(i, c, d) for i, (c, d) in enumerate(LOCALES.items())],
        "i int, locale string, description string",
    )
    counts = customers.groupBy(F.col("c_nationkey").alias("i")).agg(
        F.count("*").alias("customers"))
    return listed.join(counts, "i", "left").drop("i")
