"""Connected components over a table of links, by alternating large and small stars."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
from pyspark.sql import DataFrame, functions as F

from veilspark.session import materialize


def forest(pairs: Iterable[tuple[int, int]]) -> dict[int, int]:
    """Node -> smallest node of its component, for the links that one task has found."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while parent.setdefault(root, root) != root:
            root = parent[root]
        while parent[x] != root:
            parent[x], x = root, parent[x]
        return root

    for a, b in pairs:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in parent}


def spread_minimum(label: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Lower ``label`` (an index per node) along links until both ends agree."""
    while True:
        low = np.minimum(label[left], label[right])
        new = label.copy()
        np.minimum.at(new, left, low)
        np.minimum.at(new, right, low)
        np.minimum.at(new, label[left], low)
        np.minimum.at(new, label[right], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def components(links: DataFrame, name: str, rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``links`` (a, b), component = smallest node.

    Every round rewrites the links so that each node hangs on a smaller one, and ends
    when nothing changes: each component is then a star around its smallest node. The
    links stay in written tables; the driver sees a count and a checksum per round.
    Links with a null end or of a node with itself are ignored. Empty in, empty out.
    """
    clean = (
        links.filter(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    edges = materialize(clean, f"{name}-links")
    seen = None
    for _ in range(rounds):
        edges = materialize(_small_star(_large_star(edges)), f"{name}-links")
        # a sum of hashes does not depend on the order of rows
        state = edges.agg(
            F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).head()
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError("components did not settle")
    return (
        edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
        .unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")))
        .distinct()
    )


def _large_star(edges: DataFrame) -> DataFrame:
    """Larger neighbours of each node move to the smallest neighbour (or the node)."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("m"))
    return (
        edges.select(F.col("b").alias("v"), F.col("a").alias("u"))  # u > v
        .join(low.withColumnRenamed("a", "v"), "v")
        .select(F.col("u").alias("a"), F.least("v", "m").alias("b")).distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    """Smaller neighbours of each node, and the node, move to the smallest of them."""
    low = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(low, "a").filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return low.select("a", F.col("m").alias("b")).unionByName(moved).distinct()
