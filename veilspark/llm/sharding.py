"""Sharding by best-fit-decreasing bin packing of indivisible groups.

Groups (rows with equal text) are sorted by size and enter the bin with the least room
that still takes them; a balanced tree keeps the bins by room. Up to ``ITEMS`` groups enter
the shards at once. More are too many for one task, so small ones are first packed into
bundles, by the same method, in tasks of a bounded number of groups; bundles and large
groups then enter the shards. The number of these is bounded by parameters: bundles that are
still too many are bundled again.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from veilspark.session import materialize

from .common import gapless, stored

#: Groups that one task packs, bundles and large groups that the driver packs (both are
#: (key, size) pairs), and large groups or bundles per shard.
GROUPS_PER_TASK = 50_000
ITEMS = 100_000
PER_SHARD = 1024


class Rooms:
    """Open bins by room left: a two-level balanced tree of sorted leaves."""

    LEAF = 256

    def __init__(self) -> None:
        self.leaves: list[list[tuple[int, int]]] = [[]]
        self.tops: list[tuple[int, int]] = []  # largest entry of every leaf but the last

    def add(self, room: int, number: int) -> None:
        at = bisect_left(self.tops, (room, number))
        leaf = self.leaves[at]
        insort(leaf, (room, number))
        if len(leaf) > self.LEAF:
            half = len(leaf) // 2
            self.leaves[at:at + 1] = [leaf[:half], leaf[half:]]
            self.tops.insert(at, leaf[half - 1])

    def take(self, size: int) -> tuple[int, int] | None:
        """Remove and give the bin with the least room of at least ``size``."""
        at = bisect_left(self.tops, (size, -1))
        while at < len(self.leaves):
            leaf = self.leaves[at]
            i = bisect_left(leaf, (size, -1))
            if i < len(leaf):
                found = leaf.pop(i)
                if not leaf and len(self.leaves) > 1:
                    del self.leaves[at]
                    del self.tops[min(at, len(self.tops) - 1)]
                return found
            at += 1
        return None


def best_fit_decreasing(sizes: list[int], capacity: int) -> list[int]:
    """A bin number for each of ``sizes`` (given in decreasing order, none over capacity)."""
    rooms, bins, out = Rooms(), 0, []
    for size in sizes:
        found = rooms.take(size)
        if found is None:
            found = (capacity, bins)
            bins += 1
        out.append(found[1])
        rooms.add(found[0] - size, found[1])
    return out


def fill_shards(sizes: list[int], shards: int) -> list[int]:
    """A shard for each of ``sizes`` (decreasing), with the least capacity that suffices.

    A group larger than an equal share has a shard to itself; the others share the rest.
    """
    out: list[int] = []
    total, left = sum(sizes), shards
    while len(out) < len(sizes) and left > 1 and sizes[len(out)] * left >= total:
        total -= sizes[len(out)]
        out.append(shards - left)
        left -= 1
    rest = sizes[len(out):]
    if not rest:
        return out
    low, high = max(rest[0], -(-total // left)), max(rest[0], -(-total // left)) + rest[0]
    best = None
    while low < high or best is None:
        middle = (low + high) // 2
        bins = best_fit_decreasing(rest, middle)
        if max(bins) < left:
            best, high = bins, middle
            if low >= high:
                break
        elif low >= high:
            low, high = high + 1, high + 1 + rest[0]
        else:
            low = middle + 1
    return out + [shards - left + b for b in best]


def _bundled(items: DataFrame, capacity: int, tasks: int) -> DataFrame:
    """(item, bundle, size) where small items of one task are packed into bundles."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "item"], ascending=[False, True])
        bins = best_fit_decreasing(pdf["size"].tolist(), capacity)
        return pd.DataFrame({"item": pdf["item"], "size": pdf["size"],
                             "bundle": [f"{pdf['bucket'].iloc[0]}-{b}" for b in bins]})

    small = items.filter(F.col("size") <= capacity // 4).withColumn(
        "bucket", F.pmod(F.xxhash64("item"), F.lit(tasks)))
    return (
        small.groupBy("bucket").applyInPandas(pack, "item string, size long, bundle string")
        .unionByName(items.filter(F.col("size") > capacity // 4)
                     .select("item", "size", F.col("item").alias("bundle")))
    )


def assign_groups(groups: DataFrame, shards: int, name: str = "shards") -> DataFrame:
    """(item, shard) for distinct groups (item string, size long > 0)."""
    spark = groups.sparkSession
    total, n = groups.agg(F.sum("size"), F.count("*")).head()
    steps = []
    items = groups
    capacity = max(4, (total or 0) // (shards * PER_SHARD))
    while n > ITEMS:  # else all groups enter the shards by size at once
        bundled = materialize(_bundled(items, capacity, -(-n // GROUPS_PER_TASK) or 1),
                              f"{name}-bundles")
        steps.append(bundled.select("item", "bundle"))
        items = bundled.groupBy(F.col("bundle").alias("item")).agg(F.sum("size").alias("size"))
        before, n = n, items.count()
        if n > ITEMS and n > before // 2:
            capacity *= 4
    rows = sorted(((r["size"], r["item"]) for r in items.collect()), key=lambda x: (-x[0], x[1]))
    chosen = fill_shards([size for size, _ in rows], shards)
    placed = spark.createDataFrame(
        [(item, shard) for (_, item), shard in zip(rows, chosen, strict=True)],
        "bundle string, shard int")
    for step in reversed(steps):
        placed = step.join(placed, "bundle").select(F.col("item").alias("bundle"), "shard")
    return placed.withColumnRenamed("bundle", "item")


def shard(df: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text",
          name: str = "shards") -> DataFrame:
    """(id, size, text_crc32, shard, slot) with near-equal bytes and equal texts together.

    Size is the text's UTF-8 bytes plus 1. A null text counts as empty (checksum 0, size
    1) and shares the group of empty texts. Slots are gapless from 0 in each shard.
    Repeated rows stay together in one shard, each in its slot. Other columns are left
    out; an empty table stays empty.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = stored(df.select(
        F.col(id_col),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.sha2(text.cast("binary"), 256).alias("item"),
    ), f"{name}-rows")
    groups = materialize(rows.groupBy("item").agg(F.sum("size").alias("size")), f"{name}-groups")
    placed = materialize(assign_groups(groups, shards, name), f"{name}-placed")
    # numbered by the task that read a row: a hot group is spread over all of these
    dealt = materialize(rows.join(placed, "item"), f"{name}-dealt")
    numbered = gapless(dealt, ["shard"], [F.col(id_col), F.col("item")], "slot")
    return numbered.select(id_col, "size", "text_crc32", "shard", "slot")
