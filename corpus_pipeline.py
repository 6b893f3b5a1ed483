"""Language ID, SimHash near-dedup, personal data, packing: one stage after the other.

Each stage takes (spark, docs, folder) and returns a DataFrame, which :func:`run` writes to
the shared folder and reads again for the next one. All but the last return the columns
of ``documents``; the last returns packed pieces.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from veilspark.llm import langid, packing, pii, simhash
from veilspark.session import materialize

#: A text is rejected if no language has at least this share of the probability.
LEAST_SCORE = 0.5


def language(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Drops texts without a recognised language (null, no letter, or undecided)."""
    trees = langid.fit(docs)
    told = langid.predict(docs, trees, keep=True)
    return told.filter(
        (F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE)
    ).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Keeps the document with the smallest id of each group (null ids last).

    Rows that repeat a document, id and text, count as copies of it.
    """
    keys = [F.xxhash64("doc_id", "text").alias("_k1"),
            F.xxhash64(F.lit(1), "doc_id", "text").alias("_k2")]
    marked = docs.select("*", *keys)
    narrow = marked.select(
        F.struct(F.col("doc_id").isNull().alias("absent"), "doc_id", "_k1", "_k2").alias("key"),
        "text")
    found = simhash.near_duplicates(narrow, words=4, bits=4, id_col="key")
    kept = materialize(found.filter(F.col("key") == F.col("component"))
                       .select("key._k1", "key._k2").distinct(), "kept")
    return (marked.join(kept, ["_k1", "_k2"], "left_semi").dropDuplicates(["_k1", "_k2"])
            .select(*docs.columns))


def personal_data(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Replaces personal data in the texts; ``n_chars`` follows."""
    clean = pii.redact(docs, pii.fit(docs))
    return clean.withColumn("n_chars", F.when(
        F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))


def pack(spark: SparkSession, docs: DataFrame, folder: str) -> DataFrame:
    """Packs the texts into sequences of at most 2048 tokens."""
    return packing.pack_documents(docs, str(public_tokenizers.path("word_bpe_49k.json")), 2048)


STAGES = [
    ("language_id", language),
    ("simhash_dedup", near_duplicates),
    ("pii", personal_data),
    ("packing", pack),
]

#: Language models, span fields and packing plans are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, folder: str) -> DataFrame:
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, folder), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, folder)
