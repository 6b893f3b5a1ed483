"""SimHash near-duplicates, candidates found by pigeonring filtering.

64 bits are cut into a ring of five segments. If two fingerprints differ in at most
``bits`` places, there is a segment from which every chain of 1, 2, ... 5 consecutive
segments holds at most its share of the differences (``length * bits / 5``, rounded
down). With four bits that means: the first segment is equal and the second differs in at
most one bit, so one of its halves is equal. Fingerprints meet on (start, first segment,
half), are tested for the whole chain from that start, and only then for the distance.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from veilspark.session import materialize

from .common import map_rows
from .graph import components, spread_minimum

SEED = 42
WIDTHS = (13, 13, 13, 13, 12)  # of the ring's segments, from the lowest bit
#: Fingerprints with one key that are compared in one piece; more are tiled.
BLOCK = 4096


def fingerprint(text: str, words: int) -> int:
    """The 64-bit SimHash of a text as an unsigned integer; no words: 0."""
    parts = text.encode().lower().split()  # of bytes: A-Z only, and the six ASCII spaces
    if not parts:
        return 0
    joined = b" ".join(parts)
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(lengths + 1) - 1
    k = min(words, len(parts))
    starts = (ends - lengths)[:len(parts) - k + 1].tolist()
    ends = ends[k - 1:].tolist()
    digest = xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for at in range(0, len(starts), 50_000):
        h = np.array([digest(joined[s:e], SEED) for s, e in zip(
            starts[at:at + 50_000], ends[at:at + 50_000], strict=True)], np.uint64)
        ones += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1,
                              bitorder="little").sum(axis=0, dtype=np.int64)
    set_bits = np.nonzero(2 * ones > len(starts))[0]
    return sum(1 << int(b) for b in set_bits)


def fingerprints(df: DataFrame, words: int, id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """(id, fp) with the fingerprint of every whole text as a signed long, row by row.

    A null text counts as empty, an empty one has fingerprint 0; repeated rows stay;
    other columns are left out.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def step(group):
        for row in group:
            value = fingerprint(row["text"] or "", words)
            yield {"id": row["id"], "fp": value - (value >> 63 << 64)}

    return map_rows(rows, step, f"id {kind}, fp long", weigh="text")


def _shares(bits: int) -> list[int]:
    return [(n + 1) * bits // len(WIDTHS) for n in range(len(WIDTHS))]


def _keys(bits: int):
    """Join keys of column ``fp``: one per start and half (or one per start)."""
    first, second = _shares(bits)[:2]
    if first:
        raise ValueError("at most 4 bits: one of five segments must be equal")
    at = np.cumsum([0, *WIDTHS]).tolist()

    def field(low: int, width: int):
        return F.shiftrightunsigned("fp", low).bitwiseAND(F.lit((1 << width) - 1))

    out = []
    for i in range(len(WIDTHS)):
        j = (i + 1) % len(WIDTHS)
        half = WIDTHS[j] // 2
        parts = [(at[j], half), (at[j] + half, WIDTHS[j] - half)]
        if second == 0:
            parts = [(at[j], WIDTHS[j])]
        for n, (low, width) in enumerate(parts):
            out.append(F.lit((2 * i + n) << 32).bitwiseOR(
                F.shiftleft(field(at[i], WIDTHS[i]), 16)).bitwiseOR(field(low, width)))
    return F.array(*out)


def _near(x: np.ndarray, y: np.ndarray, start: np.ndarray, bits: int) -> np.ndarray:
    """Which pairs pass the chain from ``start`` and then the full distance."""
    diff = x ^ y
    at = np.cumsum([0, *WIDTHS])
    each = np.stack([np.bitwise_count((diff >> np.uint64(a)) & np.uint64((1 << w) - 1))
                     for a, w in zip(at.tolist(), WIDTHS, strict=False)])
    passed = np.ones(len(x), bool)
    total = np.zeros(len(x), np.int64)
    rows = np.arange(len(x))
    for n, share in enumerate(_shares(bits)):
        total += each[(start + n) % len(WIDTHS), rows]
        passed &= total <= share
    return passed & (np.bitwise_count(diff) <= bits)


def _links_in_runs(tile: np.ndarray, start: np.ndarray, fp: np.ndarray, side: np.ndarray,
                   bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Star links among rows of equal tile (rows sorted by it); ``side`` 2 meets side 1."""
    n = len(tile)
    label = np.arange(n)
    x = fp.view(np.uint64)
    run_end = np.searchsorted(tile, tile, side="right")
    alive = np.nonzero(run_end - np.arange(n) > 1)[0]
    lag, left, right, held = 1, [], [], 0
    while len(alive):
        alive = alive[alive + lag < run_end[alive]]
        for at in range(0, len(alive), 1_000_000):
            a = alive[at:at + 1_000_000]
            b = a + lag
            keep = (side[a] == 0) | (side[a] != side[b])
            a, b = a[keep], b[keep]
            near = _near(x[a], x[b], start[a], bits)
            left.append(a[near])
            right.append(b[near])
            held += int(near.sum())
            if held > 2_000_000:
                label = spread_minimum(label, np.concatenate(left), np.concatenate(right))
                left, right, held = [], [], 0
        lag += 1
    if left:
        label = spread_minimum(label, np.concatenate(left), np.concatenate(right))
    moved = np.nonzero(label != np.arange(n))[0]
    return fp[moved], fp[label[moved]]


def links(distinct: DataFrame, bits: int, name: str) -> DataFrame:
    """Links (a, b) that connect all fingerprints (column ``fp``, distinct) within ``bits``.

    Each task gives star links, so a group of g near fingerprints costs g rows and not
    g * g. A key with more than ``BLOCK`` fingerprints is cut into blocks, and each pair
    of blocks is a key of its own: a hot key is spread over many tasks and stays whole.
    """
    keyed = materialize(distinct.select("fp", F.explode(_keys(bits)).alias("key")), f"{name}-keys")
    hot = (
        keyed.groupBy("key").count().filter(F.col("count") > BLOCK)
        .select("key", F.ceil(F.col("count") / BLOCK).cast("long").alias("blocks"))
    )
    tiled = (
        keyed.join(hot, "key", "left")
        .withColumn("block", F.when(F.col("blocks").isNotNull(), F.pmod(
            F.xxhash64("fp"), F.col("blocks"))))
        .withColumn("other", F.explode(F.when(
            F.col("blocks").isNotNull(), F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
        ).otherwise(F.array(F.lit(None).cast("long")))))
        .select(
            "key", "fp",
            F.coalesce(F.least("block", "other"), F.lit(0)).alias("one"),
            F.coalesce(F.greatest("block", "other"), F.lit(0)).alias("two"),
            # 0: all meet; else only rows of different blocks meet
            F.when(F.col("block").isNull() | (F.col("block") == F.col("other")), 0)
            .when(F.col("block") < F.col("other"), 1).otherwise(2).cast("long").alias("side"),
        )
    )
    dealt = tiled.repartition("key", "one", "two").sortWithinPartitions("key", "one", "two", "fp")

    def run(batches):
        rest = np.zeros((0, 5), np.int64)
        for batch in batches:
            new = np.stack([batch.column(c).to_numpy().astype(np.int64)
                            for c in ("key", "fp", "side", "one", "two")], axis=1)
            rows = np.concatenate([rest, new])
            differ = np.nonzero((rows[1:, [0, 3, 4]] != rows[:-1, [0, 3, 4]]).any(axis=1))[0]
            cut = int(differ[-1]) + 1 if len(differ) else 0
            rows, rest = rows[:cut], rows[cut:]
            yield from found(rows)
        yield from found(rest)

    def found(rows):
        if len(rows) > 1:
            tile = np.concatenate([[0], np.cumsum(
                (rows[1:, [0, 3, 4]] != rows[:-1, [0, 3, 4]]).any(axis=1))])
            a, b = _links_in_runs(tile, rows[:, 0] >> 33, rows[:, 1].copy(), rows[:, 2], bits)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return dealt.mapInArrow(run, "a long, b long")


def near_duplicates(df: DataFrame, words: int = 4, bits: int = 4, id_col: str = "doc_id",
                    text_col: str = "text", name: str = "simhash") -> DataFrame:
    """(id, fp, component) of every row; texts within ``bits`` are linked.

    ``component`` is the smallest id reachable over links, the row's own included. Equal
    fingerprints are one node, so copies cost one row. Null or empty texts have
    fingerprint 0 and are linked like others; a null id takes the component of its
    group (null if it is alone); repeated rows stay; an empty table stays empty.
    """
    rows = materialize(fingerprints(df, words, id_col, text_col), f"{name}-fp")
    nodes = materialize(rows.groupBy("fp").agg(F.min("id").alias("first")), f"{name}-nodes")
    found = components(links(nodes.select("fp"), bits, name), name)
    joined = nodes.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "component", F.coalesce("component", "fp"))
    least = joined.groupBy("component").agg(F.min("first").alias("least"))
    by_fp = materialize(
        joined.join(least, "component").select("fp", F.col("least").alias("component")),
        f"{name}-classes")
    return rows.join(by_fp, "fp").select(F.col("id").alias(id_col), "fp", "component")
