"""The registered queries of the training-data operators, over their whole tables."""

from __future__ import annotations

import zlib

import public_tokenizers
from pyspark.sql import functions as F

from veilspark.session import fresh_path

from . import (
    bpe, html, langid, nearest, neardup, packing, periodic, perplexity, pii, sharding, simhash,
    spelling, warc)
from .common import table

QUERIES = {}
ORACLES: dict[str, str] = {}


def query(run):
    QUERIES[run.__name__] = run
    return run


@query
def op1_best_fit_packing(spark, folder):
    return packing.pack_documents(
        table(spark, folder, "documents"), str(public_tokenizers.path("word_bpe_49k.json")), 2048)


@query
def op2_bpe(spark, folder):
    encoded = bpe.encode(table(spark, folder, "documents"),
                         str(public_tokenizers.path("byte_bpe_50k.json")), decoded=True)
    return encoded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


@query
def op4_language_id(spark, folder):
    docs = table(spark, folder, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    trees = langid.fit(docs.filter(~held_out))
    return langid.predict(docs, trees).select(
        "doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score")


@query
def op6_sharding(spark, folder):
    return sharding.shard(table(spark, folder, "documents"), 8).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"))


@query
def op10_simhash(spark, folder):
    return simhash.near_duplicates(table(spark, folder, "documents"), words=4, bits=4).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"))


@query
def op7_pii(spark, folder):
    docs = table(spark, folder, "documents")
    found = pii.find(docs, pii.fit(docs))
    listed = lambda spans: F.array_join(F.transform(
        spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["base"])
    count = lambda kind: F.size(F.filter(
        base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", *[count(k) for k in pii.KINDS],
        F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"))


@query
def op3_html_extraction(spark, folder):
    return html.extract(table(spark, folder, "pages")).withColumn(
        "n_chars", F.length("text").cast("long"))


@query
def op5_embedding_near_dedup(spark, folder):
    return neardup.near_vectors(table(spark, folder, "embeddings"), 0.98)


@query
def op8_warc(spark, folder):
    path = fresh_path(spark, "archives")
    warc.write_archives(table(spark, folder, "pages"), path)
    return warc.read_archives(spark, path).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op9_nearest_neighbours(spark, folder):
    vectors = table(spark, folder, "embeddings")
    return nearest.nearest(vectors.filter("vec_id % 20 = 0"), vectors, 20)


def letter_dropped(doc_id, word: str) -> str:
    """Every 31st pair of document and word, by their hash, loses a letter (null ids none)."""
    if doc_id is None:
        return word
    h = zlib.crc32(f"{doc_id}:{word}".encode())
    at = h % len(word)
    return word if h % 31 else word[:at] + word[at + 1:]


@query
def op11_spelling(spark, folder):
    counted = spelling.word_counts(table(spark, folder, "documents"), edit=letter_dropped)
    return spelling.variants(counted.filter("n >= 2"))


@query
def op12_quality_rules(spark, folder):
    return perplexity.quality(table(spark, folder, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "bits")


def made_periodic(doc_id, words: list[bytes]) -> list[bytes]:
    """Every tenth document, by the hash of its id, repeats a stretch of its words to the end."""
    n = len(words)
    if doc_id is None or not n:
        return words
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


@query
def op13_periodic_runs(spark, folder):
    found = periodic.periodic_runs(table(spark, folder, "documents"), edit=made_periodic)
    lines = F.array_join(F.transform("runs", lambda r: F.concat(
        F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "top.start", "top.length", "top.period",
        F.expr("1000 * top.length div top.period").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), "collapsed_sha256")
