"""WARC archives: written by Spark's text writer, read back by boundary-chain verification.

A record names its length, so each place that looks like the start of a record names its
successor. Places inside a payload can look the same. Tasks emit every candidate with its
successor; from the start of each file the successors are followed by pointer jumping, in
which every step doubles the distance, and only what is reached is a record.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from veilspark.session import materialize

VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payloads of fewer bytes are never revisits.
LEAST = 100
#: About as many bytes are put into one archive file; a file is read by one task.
FILE_BYTES = 32 << 20
_MAGIC = re.compile(rb"WARC/1\.[01]\r\n")
_PAGE = re.compile(rb"<urn:page:(-?[0-9]+)>")


def write_archives(df: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url",
                   html_col: str = "html", least: int = LEAST,
                   file_bytes: int = FILE_BYTES) -> None:
    """Write one record per row into WARC files below ``path``.

    Of rows with equal payloads of at least ``least`` bytes, the one with the smallest id
    is a response and the others are revisits that name it; null ids never are the
    smallest. Rows that repeat the smallest id with its payload are responses too. Null
    html is an empty payload. The digests that occur more than once are a written table;
    Spark broadcasts it if its files are below the threshold, else it joins by shuffle.
    """
    html = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    rows = df.select(
        F.col(id_col).cast("long").alias("id"),
        F.regexp_replace(F.col(url_col).cast("string"), r"[\x00-\x20]", "%20").alias("url"),
        html.alias("html"), F.sha2(html.cast("binary"), 256).alias("digest"),
        F.octet_length(html).cast("long").alias("bytes"))
    # the hash twice, of narrow rows, costs less than moving the payloads
    total, n = rows.agg(F.sum("bytes"), F.count("*")).head()
    firsts = materialize(
        rows.filter(F.col("bytes") >= least).groupBy("digest")
        .agg(F.min("id").alias("first"), F.count("*").alias("n"))
        .filter("n > 1 and first is not null").select("digest", "first"), "warc-firsts")
    line = "\r\n"
    again = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{line}Content-Type: text/html; charset=UTF-8{line}"
                          "Content-Length: "), F.col("bytes"), F.lit(line + line))
    block = F.concat(http, F.when(again, F.lit("")).otherwise(F.col("html")))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    record = F.concat_ws(
        line, F.lit(VERSION),
        F.concat(F.lit("WARC-Type: "), F.when(again, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), urn(F.col("id"))),
        F.concat(F.lit("WARC-Target-URI: "), F.col("url")),
        F.when(again, F.concat(F.lit("WARC-Refers-To: "), urn(F.col("first")))),
        F.when(again, F.lit(f"WARC-Profile: {PROFILE}")),
        F.concat(F.lit("WARC-Payload-Digest: sha256:"), F.col("digest")),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), F.octet_length("block")),
        F.lit(""), F.col("block"), F.lit(""))
    each = max(1, int(file_bytes // max(1, (total or 0) / max(1, n) + 600)))
    # a record ends with two line breaks; the writer adds the second one
    (rows.join(firsts, "digest", "left").withColumn("block", block).select(record.alias("value"))
     .write.option("lineSep", line).option("maxRecordsPerFile", each).text(path))


_SCHEMA = pa.schema([
    ("file", pa.string()), ("offset", pa.int64()), ("next", pa.int64()), ("size", pa.int64()),
    ("record_type", pa.string()), ("page_id", pa.int64()), ("url", pa.string()),
    ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
    ("payload", pa.binary())])
_DDL = ("file string, offset long, next long, size long, record_type string, page_id long, "
        "url string, refers_to long, payload_bytes long, payload_digest string, payload binary")


def candidates(content: bytes, payload: bool):
    """Every place that looks like a whole record, with the offset of its successor."""
    for m in _MAGIC.finditer(content):
        start = m.start()
        stop = content.find(b"\r\n\r\n", m.end() - 2)
        if stop < 0:
            continue
        head = {}
        for line in content[m.end():stop].split(b"\r\n"):
            name, _, value = line.partition(b":")
            head[name.strip().lower()] = value.strip()
        length = head.get(b"content-length", b"")
        if not length.isdigit() or len(length) > 15:
            continue
        body = stop + 4
        end = body + int(length)
        if content[end:end + 4] != b"\r\n\r\n":
            continue
        block = content[body:end]
        http, _, entity = block.partition(b"\r\n\r\n")
        kind = head.get(b"warc-type", b"").decode("ascii", "replace")
        said = re.search(rb"(?im)^content-length:\s*([0-9]{1,15})\s*$", http)
        page, refers = (_PAGE.match(head.get(k, b"")) for k in (
            b"warc-record-id", b"warc-refers-to"))
        digest = head.get(b"warc-payload-digest", b"").decode("ascii", "replace")
        revisit = kind == "revisit"
        yield {
            "offset": start, "next": end + 4, "record_type": kind,
            "page_id": int(page.group(1)) if page else None,
            "url": head[b"warc-target-uri"].decode("utf-8", "replace")
            if b"warc-target-uri" in head else None,
            "refers_to": int(refers.group(1)) if refers else None,
            # a revisit has no payload of its own: its headers speak for it
            "payload_bytes": int(said.group(1)) if revisit and said else len(entity),
            "payload_digest": digest.removeprefix("sha256:") if revisit
            else hashlib.sha256(entity).hexdigest(),
            "payload": entity if payload and not revisit else None,
        }


def reached(offset: np.ndarray, successor: np.ndarray) -> np.ndarray:
    """Which candidates (sorted by offset) lie on the chain from offset 0, by doubling."""
    n = len(offset)
    jump = np.full(n + 1, n)  # place n: outside
    at = np.searchsorted(offset, successor)
    hit = (at < n) & (offset[np.minimum(at, n - 1)] == successor)
    jump[:n][hit] = at[hit]
    on = np.zeros(n + 1, bool)
    on[0] = n > 0 and offset[0] == 0
    while (jump[:n] < n).any():
        on[jump[on]] = True
        jump = jump[jump]
    return on[:n]


def read_archives(spark: SparkSession, path: str, payload: bool = False) -> DataFrame:
    """The records of all WARC files below ``path``, in no order.

    Columns: file, offset, record_type, page_id, url, refers_to, payload_bytes,
    payload_digest and, if asked for, payload (null for revisits). A file whose chain
    breaks gives the records before the break; a file that does not begin with a record
    gives none. No file, or an empty one, gives no row. Files are read whole by one task
    each, so they should have a bounded size, as :func:`write_archives` makes them.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(
        path).filter("length > 0").select("path", "content")

    def scan(batches):
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                content = content.as_py()
                rows = [{"file": name.as_py(), "size": len(content)} | c
                        for c in candidates(content, payload)]
                yield pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)

    def keep(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("offset", ignore_index=True)
        return pdf[reached(pdf["offset"].to_numpy(), pdf["next"].to_numpy())]

    return files.mapInArrow(scan, _DDL).groupBy("file").applyInPandas(keep, _DDL).select(
        "file", "offset", "record_type", "page_id", "url", "refers_to", "payload_bytes",
        "payload_digest", *["payload"] * payload)
