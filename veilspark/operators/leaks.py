"""Originals that stand in any cleaned text, not only in their own.

Values are compared by key, so no original is kept for it. A Bloom filter of all originals
goes to the tasks first: a few bits per value, in blocks of the built-in bitmap aggregate,
so that a value looks at one block. Most spans of cleaned texts fail it where they stand;
those that pass meet the originals in an exact join, so its errors cost time and nothing else.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.keys import mapping_key
from ..session import materialize
from .cleaning import CleanConfig, detect, explode_spans
from .mapping import KEY
from .skew import keyed_join

#: Bits of one block: what the bitmap aggregate holds.
BLOCK = 32768
#: Bits a value gets, and bits it sets: about 1 value in 400 passes without being there.
BITS, MARKS = 16, 4
#: A filter up to this size is sent to the tasks; beyond it all spans take the exact join.
MOST_BYTES = 64_000_000


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def _marks(key: Column) -> Column:
    return F.transform(F.sequence(F.lit(1), F.lit(MARKS)),
                       lambda i: F.pmod(F.xxhash64(i, key), F.lit(BLOCK)))


def bloom_filter(keys: DataFrame, key: str, blocks: int) -> DataFrame:
    """(block, bits): a row of 4 KB for each block that has a value."""
    return (
        keys.select(_block(F.col(key), blocks).alias("block"), F.explode(_marks(F.col(key))).alias("mark"))
        .groupBy("block").agg(F.bitmap_construct_agg("mark").alias("bits"))
    )


def might_hold(bits: Column, key: Column) -> Column:
    """Whether all marks of a key are set in its block."""
    def is_set(mark: Column) -> Column:
        byte = F.conv(F.hex(F.substring(bits, (F.floor(mark / 8) + 1).cast("int"), F.lit(1))), 16, 10)
        return F.getbit(byte.cast("int"), (mark % 8).cast("int")) == 1

    return F.forall(_marks(key), is_set)


def corpus_leaks(cleaned: DataFrame, originals: DataFrame, config: CleanConfig = CleanConfig(),
                 text: str = "anonymized_text", bits: int = BITS, most_bytes: int = MOST_BYTES
                 ) -> DataFrame:
    """Spans of cleaned texts that are an original of any text: the columns of ``cleaned``
    but the text, then entity_type, start, end and original_hash.

    ``originals`` holds keys (original_hash, entity_type), repeated or not. What is looked
    for is what ``config`` detects; types whose substitutes come from short lists (dates,
    places) meet originals by chance and are better left out of it.
    """
    known = originals.select(*KEY).filter(F.col("entity_type").isin(*config.types)).distinct()
    known = materialize(known, "originals")
    kept = [c for c in cleaned.columns if c not in (text, "detections")]
    found = explode_spans(detect(cleaned.select(*kept, text), config, text), "detections", *kept)
    spans = found.select(
        *kept, "entity_type", "start", "end",
        mapping_key(F.col("text"), F.col("entity_type"), config.secret).alias("original_hash"))
    blocks = max(1, -(-known.count() * bits // BLOCK))
    if blocks * BLOCK // 8 <= most_bytes:
        sieve = bloom_filter(known, "original_hash", blocks)
        spans = (
            spans.withColumn("block", _block(F.col("original_hash"), blocks))
            .join(F.broadcast(sieve), "block")
            .filter(might_hold(F.col("bits"), F.col("original_hash"))).drop("block", "bits")
        )
    survivors = materialize(spans.withColumn("_row", F.monotonically_increasing_id()), "survivors")
    return keyed_join(survivors, known.select("original_hash"), "original_hash", "_row").select(
        *kept, "entity_type", "start", "end", "original_hash")
