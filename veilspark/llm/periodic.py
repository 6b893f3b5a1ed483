"""Periodic runs of words: tiles per octave of periods, Z-functions at their boundaries.

A run is a stretch of words with smallest period q, at least ``max(least, times * q)`` words
long, that no neighbouring word extends. Periods are taken by octave, ``2**k <= q < 2**(k+1)``.
For each octave the text has a tile boundary every ``2**k`` words; the tile around boundary c
is the words from ``c - 2**k`` to ``c + 5 * 2**k``, so tiles overlap. A run of four periods
or more holds a boundary with two of its periods behind it, and every stretch of it is seen
whole from one of its boundaries. In a tile, the Z-function of the words from the boundary
says how far each period of the octave goes on and whether a shorter period explains it; the
Z-function of the words read backwards says how far it reaches back. Tiles are solved apart
from each other; their fragments, intervals of equal words q apart, are shuffled by document
and period and stitched where they meet.

Tiles without a block of ``2**k`` words that comes again at a distance of the octave hold
nothing; block hashes tell, and equal blocks always have equal hashes, so no run is lost. A
text of up to ``WHOLE`` words is exploded and solved in the task that reads it; the tiles of
longer ones are dealt over the cluster by document, octave and place.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Callable
from fractions import Fraction

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from veilspark.session import materialize

from .common import map_rows

#: Longer texts (in words) have their tiles dealt over the cluster.
WHOLE = 200_000
#: Words between the first and last boundary of the tiles that travel together.
SPAN = 65_536

_FRAGMENT = "struct<period:long,start:long,stop:long>"
_RUN = "struct<start:long,length:long,period:long>"


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space (space, tab to carriage return), as UTF-8."""
    return (text or "").encode().split()


def numbered(words: list[bytes]) -> np.ndarray:
    """Each word as the number of its first like."""
    seen: dict[bytes, int] = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))


def z_function(s: list) -> list[int]:
    """z[i]: how many items from i on equal those from the start (z[0] is the length)."""
    n = len(s)
    z = [0] * n
    if n:
        z[0] = n
    left = right = 0
    for i in range(1, n):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def tile_fragments(words: np.ndarray, c: int, k: int) -> list[tuple[int, int, int]]:
    """(period, start, stop) seen from boundary c: words q apart are equal from start to stop.

    Periods of octave k that hold for two periods from c and that no shorter one explains.
    """
    n, block = len(words), 1 << k
    ahead = z_function(words[c:c + 5 * block].tolist())
    low, high = max(0, c - block), min(n, c + 2 * block)
    back = words[low:c][::-1].tolist()
    behind = z_function([*back, -1, *words[low:high][::-1].tolist()])
    found, reach = [], 0  # reach: the longest stretch from c with a shorter period
    for q in range(1, min(2 * block, len(ahead))):
        if q >= block and ahead[q] >= q and reach < 2 * q:
            b = behind[len(back) + 1 + high - c - q] if back and c + q <= high else 0
            found.append((q, c - b, c + ahead[q]))
        reach = max(reach, q + ahead[q])
    return found


def boundaries(words: np.ndarray, hashes: np.ndarray, k: int) -> np.ndarray:
    """Boundaries at which some period of octave k holds for two periods, by block hashes.

    ``hashes[i]`` is that of the ``2**k`` words from i.
    """
    block = 1 << k
    rows = (len(hashes) - block + block - 1) // block  # boundaries with a block after them
    if rows <= 0:
        return np.empty(0, np.int64)
    later = np.full(rows * block, -1, np.int64)
    there = np.zeros(rows * block, bool)
    later[:len(hashes) - block] = hashes[block:]
    there[:len(hashes) - block] = True
    row, step = np.nonzero(
        (later.reshape(rows, block) == hashes[:rows * block:block][:rows, None])
        & there.reshape(rows, block))
    c, q = row * block, row * 0 + block + step
    inside = c + 2 * q <= len(words)
    c, q = c[inside], q[inside]
    return np.unique(c[hashes[c + q - block] == hashes[c + 2 * q - block]])


def doubled(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of blocks of ``2**(k+1)`` words from those of ``2**k``."""
    block = 1 << k
    if len(hashes) <= block:
        return hashes[:0]
    first, second = hashes[:-block].view(np.uint64), hashes[block:].view(np.uint64)
    mixed = first * np.uint64(0x9E3779B97F4A7C15) + second * np.uint64(0xC2B2AE3D27D4EB4F)
    return (mixed ^ (mixed >> np.uint64(29))).view(np.int64)


def joined(fragments: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Fragments of one period that overlap or touch made one."""
    out: list[tuple[int, int, int]] = []
    for q, start, stop in sorted(fragments):
        if out and out[-1][0] == q and start <= out[-1][2]:
            out[-1] = (q, out[-1][1], max(stop, out[-1][2]))
        else:
            out.append((q, start, stop))
    return out


def long_enough(q: int, start: int, stop: int, least: int, times: int) -> bool:
    return stop - start + q >= max(least, times * q)


def text_fragments(words: np.ndarray, least: int, times: int) -> list[tuple[int, int, int]]:
    """The stitched fragments of a whole text that are long enough, all octaves."""
    out: list[tuple[int, int, int]] = []
    hashes, k = words, 0
    while times << k <= len(words):
        found = []
        for c in boundaries(words, hashes, k).tolist():
            # two periods from c inside a run of a shorter period are explained by it
            if not any(s <= c and c + (4 << k) <= e + q for q, s, e in out):
                found += tile_fragments(words, c, k)
        out += [f for f in joined(found) if long_enough(*f, least, times)]
        hashes, k = doubled(hashes, k), k + 1
    return out


def _tile_rows(words: np.ndarray, times: int) -> list[dict]:
    """The tiles of a long text, those of an octave gathered over ``SPAN`` words."""
    rows, k = [], 0
    while times << k <= len(words):
        block = 1 << k
        step = max(block, SPAN)
        for first in range(0, len(words), step):
            low, high = max(0, first - block), min(len(words), first + step + 5 * block)
            rows.append({"octave": k, "first": first, "low": low, "step": step,
                         "words": words[low:high].astype("<i8").tobytes()})
        k += 1
    return rows


def _solved(row: dict) -> list[tuple[int, int, int]]:
    words, k, low = np.frombuffer(row["words"], "<i8"), row["octave"], row["low"]
    hashes = words
    for j in range(k):
        hashes = doubled(hashes, j)
    found = []
    for c in boundaries(words, hashes, k).tolist():
        if row["first"] <= c + low < row["first"] + row["step"]:
            found += [(q, s + low, e + low) for q, s, e in tile_fragments(words, c, k)]
    return joined(found)


def periodic_runs(docs: DataFrame, text: str = "text", id_col: str = "doc_id", least: int = 6,
                  times: int = 4, edit: Callable[[object, list[bytes]], list[bytes]] | None = None,
                  whole: int = WHOLE) -> DataFrame:
    """(id, n_words, runs, top, collapsed, collapsed_sha256), one row per row of ``docs``.

    ``runs`` has every run's start (word number from 0), length and period, by start, then
    period; ``top`` is the one with the greatest length / period (ties: smallest start, then
    period), null without runs. ``collapsed`` is the words joined by one space without
    those after the first period of a run; it is null where nothing is dropped, while its
    SHA-256 is always there. ``edit(id, words)`` may change the words before. Null and
    empty texts have no words; ids may be null or repeat; empty in, empty out.
    """
    if times < 4:
        raise ValueError("tiles are laid for runs of four periods or more")

    def read(rows):
        for row in rows:
            words = words_of(row["_text"])
            if edit is not None:
                words = edit(row["_id"], words)
            far = len(words) > whole
            found = [] if far else text_fragments(numbered(words), least, times)
            plain = b" ".join(words)
            yield {
                "_id": row["_id"], "n_words": len(words), "_far": far,
                "_found": [dict(zip(("period", "start", "stop"), f, strict=True)) for f in found],
                "_plain": plain.decode() if found or far else None,
                "collapsed_sha256": hashlib.sha256(plain).hexdigest(),
            }

    kind = docs.select(F.col(id_col)).schema[0].dataType.simpleString()
    texts = map_rows(
        docs.select(F.col(id_col).alias("_id"), F.col(text).alias("_text")), read,
        f"_id {kind}, n_words long, _far boolean, _found array<{_FRAGMENT}>, _plain string, "
        "collapsed_sha256 string", weigh="_text")
    texts = materialize(texts.withColumn("_row", F.monotonically_increasing_id()), "texts")
    runs = materialize(
        _stitched(_fragments(texts, times), least, times).groupBy("_row").agg(
            F.sort_array(F.collect_list(F.struct("start", "length", "period"))).alias("runs")),
        "runs")
    odd = texts.filter("_plain is not null").join(runs, "_row", "left")
    named = [F.col("_id").alias(id_col), "n_words", "runs", "top", "collapsed", "collapsed_sha256"]
    none = texts.filter("_plain is null").select(
        "*", F.expr(f"cast(array() as array<{_RUN}>)").alias("runs"),
        F.expr(f"cast(null as {_RUN})").alias("top"), F.lit(None).cast("string").alias("collapsed"))
    ends = map_rows(
        odd.select("_id", "n_words", "_plain", "runs"), lambda rows: map(_collapsed, rows),
        f"_id {kind}, n_words long, runs array<{_RUN}>, top {_RUN}, collapsed string, "
        "collapsed_sha256 string", weigh="_plain")
    return none.select(*named).unionByName(ends.select(*named))


def _fragments(texts: DataFrame, times: int) -> DataFrame:
    """(_row, period, start, stop) of all texts; the tiles of long ones are dealt out."""
    near = texts.filter("not _far").select("_row", F.inline("_found"))

    def explode(rows):
        for row in rows:
            for tile in _tile_rows(numbered(words_of(row["_plain"])), times):
                yield {"_row": row["_row"], **tile}

    def solve(rows):
        for row in rows:
            for period, start, stop in _solved(row):
                yield {"_row": row["_row"], "period": period, "start": start, "stop": stop}

    tiles = map_rows(texts.filter("_far").select("_row", "_plain"), explode,
                     "_row long, octave int, first long, low long, step long, words binary",
                     chars=1)
    far = map_rows(tiles.repartition("_row", "octave", "first"), solve,
                   "_row long, period long, start long, stop long", chars=1)
    return near.unionByName(far)


def _stitched(fragments: DataFrame, least: int, times: int) -> DataFrame:
    """(_row, start, length, period): fragments that overlap or touch made one run."""
    order = Window.partitionBy("_row", "period").orderBy("start", "stop")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    return (
        fragments.withColumn("_cut", (
            F.col("start") > F.coalesce(F.max("stop").over(before), F.lit(-1))).cast("long"))
        .withColumn("_island", F.sum("_cut").over(order))
        .groupBy("_row", "period", "_island")
        .agg(F.min("start").alias("start"), F.max("stop").alias("stop"))
        .withColumn("length", F.col("stop") - F.col("start") + F.col("period"))
        .filter(F.col("length") >= F.greatest(F.lit(least), times * F.col("period")))
        .select("_row", "start", "length", "period")
    )


def _collapsed(row: dict) -> dict:
    words, runs = words_of(row["_plain"]), row["runs"] or []
    kept = np.ones(len(words), bool)
    for r in runs:
        kept[r["start"] + r["period"]:r["start"] + r["length"]] = False
    left = b" ".join(words[i] for i in np.flatnonzero(kept).tolist())
    return {
        "_id": row["_id"], "n_words": row["n_words"], "runs": runs,
        "top": min(runs, default=None, key=lambda r: (
            -Fraction(r["length"], r["period"]), r["start"], r["period"])),
        "collapsed": left.decode() if runs else None,
        "collapsed_sha256": hashlib.sha256(left).hexdigest(),
    }
