"""Near-duplicate vectors by int8 tile products with rigorous error bounds.

A unit vector u is kept as a scale times small integers, u' = s q, with the norms of u'
and of the error e = u - u' known. For two of them

    u . v  <=  u' . v'  +  |u'| |f|  +  |e| |v'|  +  |e| |f|

so a tile product of integers tells which pairs may reach the threshold; only those are
worked out from the original vectors in double precision. The integer product runs in
float32, where it is exact: sums stay below 2 ** 24.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from veilspark.operators.skew import is_small
from veilspark.session import materialize

from .graph import components, spread_minimum
from .vectors import longs, matrix, packed, rows_of, scaled, usable

TILE = 2048
#: Room for rounding in the bounds, far above that of double precision.
SLACK = 1e-6


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(integers as float32, scale, norm of the quantised vector, norm of the error)."""
    unit = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
    # integers of at most 127, and small enough for an exact float32 sum of any length
    top = min(127, int(np.sqrt((1 << 24) / max(1, x.shape[1]))))
    scale = np.abs(unit).max(axis=1) / top
    q = np.rint(unit / scale[:, None])
    near = q * scale[:, None]
    norm = lambda a: np.sqrt((a * a).sum(axis=1))
    return q.astype(np.float32), scale, norm(near), norm(unit - near)


def tile_pairs(x: np.ndarray, y: np.ndarray, threshold: float, same: bool):
    """Index pairs (i, j) of x and y with cosine >= threshold, a few rows of x at a time."""
    x, y = scaled(x), scaled(y)
    qx, sx, nx, ex = quantise(x)
    qy, sy, ny, ey = quantise(y)
    long_x, long_y = (np.sqrt((a * a).sum(axis=1)) for a in (x, y))
    for at in range(0, len(x), 256):
        rows = slice(at, at + 256)
        bound = (qx[rows] @ qy.T) * (sx[rows, None] * sy) + (
            np.outer(nx[rows] + ex[rows], ny + ey) - np.outer(nx[rows], ny))
        i, j = np.nonzero(bound >= threshold - SLACK)
        i += at
        if same:
            i, j = i[i < j], j[i < j]
        for k in range(0, len(i), 100_000):
            a, b = i[k:k + 100_000], j[k:k + 100_000]
            cosine = (x[a] * y[b]).sum(axis=1) / (long_x[a] * long_y[b])
            hit = cosine >= threshold
            if hit.any():
                yield a[hit], b[hit]


def near_vectors(df: DataFrame, threshold: float = 0.98, id_col: str = "vec_id",
                 vec_col: str = "embedding", label_col: str = "label", tile: int = TILE,
                 name: str = "vectors") -> DataFrame:
    """(id, n_links, component_id, kept) of every row.

    Rows are compared if their labels are equal and not null and their vectors have the
    same number of components. Vectors that are null, zero or hold null or non-finite
    components, and rows with a null id, have no links and are their own component
    (kept; a null id has a null component). Equal vectors are one node with a count, so
    copies are never paired; repeated ids count as rows of their own. An empty table
    stays empty. Other columns are left out.

    Within a label, nodes are put into slabs along one direction, as wide as linked
    vectors can be apart, so only tiles of a slab and its neighbour meet. A pair of
    tiles gives link counts and star links, at most one row each per vector.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be above 0 and at most 1")
    rows = materialize(df.select(
        F.col(id_col).alias("id"), F.col(label_col).alias("label"),
        F.col(vec_col).cast("array<double>").alias("vec"),
    ).withColumn("fit", usable("vec") & F.col("label").isNotNull() & F.col("id").isNotNull()
                 ).withColumn("dim", F.size("vec"))
        .withColumn("h1", F.xxhash64("vec")).withColumn("h2", F.xxhash64(F.lit(1), "vec")),
        f"{name}-rows")
    # unit vectors with this cosine are at most `apart` from each other
    apart = float(np.sqrt(2 - 2 * threshold)) + 1e-6
    # by the largest component, as squares of huge or tiny ones leave the range
    most = F.array_max(F.transform("vec", F.abs))
    unit = F.transform("vec", lambda x: x / F.col("_most"))
    way = F.transform("_unit", lambda x, i: x * F.when(
        F.pmod(F.xxhash64(i), F.lit(2)) == 0, 1.0).otherwise(-1.0))
    plus = lambda a, b: a + b
    along = F.aggregate(way, F.lit(0.0), plus) / F.sqrt(
        F.aggregate(F.transform("_unit", lambda x: x * x), F.lit(0.0), plus)
    ) / F.sqrt(F.col("dim").cast("double"))
    nodes = materialize(
        rows.filter("fit").groupBy("label", "dim", "h1", "h2").agg(
            F.min("id").alias("node"), F.count("*").alias("copies"),
            F.min_by("vec", "id").alias("vec"))
        .withColumn("_most", most).withColumn("_unit", unit)
        .withColumn("slab", F.floor(along / apart).cast("long")).drop("_most", "_unit"),
        f"{name}-nodes")
    tiles = nodes.groupBy("label", "dim", "slab").agg(
        F.ceil(F.count("*") / tile).cast("long").alias("tiles"))
    numbered = nodes.join(
        F.broadcast(tiles) if is_small(tiles) else tiles, ["label", "dim", "slab"]).withColumn(
        "tile", F.pmod(F.xxhash64("node"), F.col("tiles")))
    keys = ["label", "dim", "slab", "tile"]
    # dealt by tile, however the counts came to the rows: a task holds tiles, not slabs
    blocks = materialize(
        packed(numbered.repartition(*keys), keys, ["node", "copies", "vec"], "rows"),
        f"{name}-blocks")
    meta = blocks.select("label", "dim", "slab", "tile")
    pairs = (
        meta.withColumn("slab2", F.explode(F.array("slab", F.col("slab") + 1)))
        .join(meta.select("label", "dim", F.col("slab").alias("slab2"),
                          F.col("tile").alias("tile2")), ["label", "dim", "slab2"])
        .filter("slab < slab2 or tile <= tile2")
    )
    other = blocks.select("label", "dim", F.col("slab").alias("slab2"),
                          F.col("tile").alias("tile2"), F.col("rows").alias("rows2"))
    met = (
        pairs.join(blocks, ["label", "dim", "slab", "tile"])
        .join(other, ["label", "dim", "slab2", "tile2"])
        .select(((F.col("slab") == F.col("slab2")) & (F.col("tile") == F.col("tile2"))
                 ).alias("same"), "rows", "rows2")
    )

    def compare(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                yield _compare(batch.column("same")[k].as_py(), rows_of(batch.column("rows"), k),
                               rows_of(batch.column("rows2"), k), threshold)

    found = materialize(met.mapInArrow(compare, "a long, b long, n long"), f"{name}-found")
    counts = found.filter("n is not null").groupBy(F.col("a").alias("node")).agg(
        F.sum("n").alias("links"))
    classes = components(found.filter("n is null").select("a", "b"), name)
    by_node = materialize(
        nodes.select("label", "dim", "h1", "h2", "node", "copies")
        .join(counts, "node", "left").join(classes, "node", "left")
        .select("label", "dim", "h1", "h2", F.lit(True).alias("fit"),
                (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"),
                F.coalesce("component", "node").alias("component_id")), f"{name}-classes")
    return (
        rows.drop("vec").join(by_node, ["label", "dim", "h1", "h2", "fit"], "left")
        .select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).alias("n_links"),
                F.coalesce("component_id", "id").alias("component_id"))
        .withColumn("kept", F.col(id_col).eqNullSafe(F.col("component_id")))
    )


def _compare(same: bool, left: pa.StructArray, right: pa.StructArray,
             threshold: float) -> pa.RecordBatch:
    node = np.concatenate([longs(left, "node"), longs(right, "node")])
    x, y = matrix(left), matrix(right)
    copies = np.concatenate([longs(left, "copies"), longs(right, "copies")])
    split = 0 if same else len(x)
    label, links = np.argsort(np.argsort(node, kind="stable"), kind="stable"), np.zeros(
        len(node), np.int64)
    # labels are ranks of node ids, so the smallest label of a group is its smallest node
    place = np.argsort(label)
    held: list[tuple[np.ndarray, np.ndarray]] = []
    root = np.arange(len(node))
    for i, j in tile_pairs(x, y, threshold, same):
        j = j + split
        np.add.at(links, i, copies[j])
        np.add.at(links, j, copies[i])
        held.append((label[i], label[j]))
        if sum(len(a) for a, _ in held) > 1_000_000:
            root = spread_minimum(root, *map(np.concatenate, zip(*held, strict=True)))
            held = []
    if held:
        root = spread_minimum(root, *map(np.concatenate, zip(*held, strict=True)))
    moved = np.nonzero(root != np.arange(len(node)))[0]
    counted = np.nonzero(links)[0]
    a = np.concatenate([node[place[moved]], node[counted]])
    b = pa.array(np.concatenate([node[place[root[moved]]], node[counted]]))
    is_link = np.arange(len(a)) < len(moved)
    n = np.concatenate([np.zeros(len(moved), np.int64), links[counted]])
    return pa.RecordBatch.from_arrays(
        [pa.array(a), b, pa.array(n, mask=is_link)], ["a", "b", "n"])
