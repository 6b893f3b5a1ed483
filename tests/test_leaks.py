"""Leaks across texts: planted ones and no others, with and without the filter."""

import pytest
from pyspark.sql import functions as F

from veilspark.functions.keys import mapping_key
from veilspark.operators.cleaning import CleanConfig
from veilspark.operators.leaks import BLOCK, bloom_filter, corpus_leaks, might_hold

CONFIG = CleanConfig(entity_types=["EMAIL_ADDRESS", "US_SSN"])


def originals(spark, values):
    df = spark.createDataFrame([(v, t) for v, t in values], "v string, entity_type string")
    return df.select(mapping_key(F.col("v"), F.col("entity_type")).alias("original_hash"), "entity_type")


@pytest.mark.parametrize("most", [64_000_000, 0])
def test_planted_leaks_are_found(spark, most):
    known = originals(spark, [("a@b.org", "EMAIL_ADDRESS"), ("456-78-9012", "US_SSN"), ("a@b.org", "EMAIL_ADDRESS"),
                              ("c@d.org", "US_SSN")] + [(f"p{i}@q.org", "EMAIL_ADDRESS") for i in range(3000)])
    texts = spark.createDataFrame(
        [(None, "write a@b.org"), (1, "see c@d.org and p7@q.org, p7@q.org"), (1, "ssn 456-78-9012"), (2, None), (3, ""),
         (4, "x@y.org")], "id int, anonymized_text string")
    got = sorted((r["id"] or 0, r["entity_type"], r["start"], r["end"])
                 for r in corpus_leaks(texts, known, CONFIG, most_bytes=most).collect())
    assert got == [(0, "EMAIL_ADDRESS", 6, 13), (1, "EMAIL_ADDRESS", 16, 24), (1, "EMAIL_ADDRESS", 26, 34),
                   (1, "US_SSN", 4, 15)]
    assert corpus_leaks(texts, known.limit(0), CONFIG, most_bytes=most).count() == 0
    assert corpus_leaks(texts.limit(0), known, CONFIG, most_bytes=most).count() == 0


def test_the_filter_never_misses_and_rarely_errs(spark):
    keys = spark.range(20_000).select(F.sha2(F.col("id").cast("string"), 256).alias("k"), "id")
    blocks = -(-10_000 * 16 // BLOCK)
    sieve = bloom_filter(keys.filter("id < 10000"), "k", blocks)
    met = keys.withColumn("block", F.pmod(F.xxhash64("k"), F.lit(blocks))).join(F.broadcast(sieve), "block", "left")
    held = met.select("id", F.coalesce(might_hold(F.col("bits"), F.col("k")), F.lit(False)).alias("y"))
    assert held.filter("id < 10000 and not y").count() == 0
    assert held.filter("id >= 10000 and y").count() < 100
