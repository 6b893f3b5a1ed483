"""Approximate nearest neighbours by stable projections, a kd-tree and a chi-square test.

The largest inner product is turned into the smallest distance: with one more component
sqrt(M^2 - |x|^2) for vectors and 0 for queries, |q - x|^2 = |q|^2 + M^2 - 2 q . x. Each
block of vectors is projected by a fixed Gaussian matrix to a few dimensions and indexed
by a kd-tree there. The squared projected distance of a pair over its true one is
chi-square distributed, so leaves are visited by projected distance and their vectors
verified, until a vector as near as the k-th best would already have shown up with the
wanted probability.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from veilspark.session import materialize

from .vectors import longs, matrix, packed, rows_of, scaled, usable

BLOCK = 8192  # vectors of one kd-tree
BATCH = 2048  # queries that meet a block together
LEAF = 128
PROJECTED = 6  # even, so that the chi-square distribution has a closed form
SURE = 0.98  # probability that a neighbour has shown up before the search ends


def chi_square(x: np.ndarray, freedom: int) -> np.ndarray:
    """The distribution function for an even number of degrees of freedom."""
    half = x / 2
    term, total = np.ones_like(half), np.ones_like(half)
    for i in range(1, freedom // 2):
        term = term * half / i
        total = total + term
    return 1 - np.exp(-half) * total


class Block:
    """One block: distinct vectors, their ids in order, projections and kd-tree leaves."""

    def __init__(self, ids: np.ndarray, x: np.ndarray):
        order = np.lexsort((ids,))
        ids, x = ids[order], np.ascontiguousarray(x[order] + 0.0)  # -0.0 becomes 0.0
        raw = x.view(np.dtype((np.void, x.dtype.itemsize * x.shape[1]))).ravel()
        _, first, which = np.unique(raw, return_index=True, return_inverse=True)
        self.given = x[first]
        # all rows by one power of two, so that products with a query compare
        most = float(np.abs(self.given).max())
        odd = most > 1e100 or most < 1e-100
        self.x = np.ldexp(self.given, -math.frexp(most)[1]) if odd else self.given
        order = np.argsort(which, kind="stable")
        self.ids = ids[order]
        self.starts = np.searchsorted(which[order], np.arange(len(first) + 1))
        self.least = self.ids[self.starts[:-1]]  # the smallest id of each vector
        squares = (self.x ** 2).sum(axis=1)
        self.bound = float(squares.max())
        lifted = np.column_stack([self.x, np.sqrt(np.maximum(0, self.bound - squares))])
        self.low = lifted @ directions(lifted.shape[1])
        self.leaves = self._split(np.arange(len(self.x)))
        self.boxes = np.array([(self.low[i].min(axis=0), self.low[i].max(axis=0))
                               for i in self.leaves])

    def _split(self, index: np.ndarray) -> list[np.ndarray]:
        if len(index) <= LEAF:
            return [index]
        low = self.low[index]
        axis = int(np.ptp(low, axis=0).argmax())
        order = index[np.argsort(low[:, axis], kind="stable")]
        middle = len(order) // 2
        return self._split(order[:middle]) + self._split(order[middle:])

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int):
        """(query row, vec_id, score) of the k best found for every query."""
        n, keep = len(queries), k + 1  # one more: a query may find itself
        given, queries = queries, scaled(queries)
        lifted = np.column_stack([queries, np.zeros(n)])
        low = lifted @ directions(lifted.shape[1])
        gap = np.maximum(self.boxes[None, :, 0] - low[:, None], 0) + np.maximum(
            low[:, None] - self.boxes[None, :, 1], 0)
        reach = (gap ** 2).sum(axis=2)
        visits = np.argsort(reach, axis=1, kind="stable")
        best = np.full((n, keep), -np.inf)
        who = np.full((n, keep), -1)
        lengths = (queries ** 2).sum(axis=1)
        alive = np.arange(n)
        for step in range(len(self.leaves)):
            leaf = visits[alive, step]
            far = reach[alive, leaf]
            worst = lengths[alive] + self.bound - 2 * best[alive].min(axis=1)
            with np.errstate(invalid="ignore", divide="ignore"):
                seen = chi_square(far / np.maximum(worst, 1e-300), PROJECTED)
            go = ~(np.isfinite(worst) & (seen >= SURE))
            alive, leaf = alive[go], leaf[go]
            if not len(alive):
                break
            order = np.argsort(leaf, kind="stable")
            cuts = np.nonzero(np.diff(leaf[order]))[0] + 1
            for group in np.split(order, cuts):
                rows, members = alive[group], self.leaves[leaf[group[0]]]
                both = np.hstack([best[rows], queries[rows] @ self.x[members].T])
                names = np.hstack([who[rows], np.broadcast_to(members, (len(rows), len(members)))])
                # of equal products the smaller ids stay
                top = np.lexsort((self.least[names], -both), axis=1)[:, :keep]
                best[rows] = np.take_along_axis(both, top, axis=1)
                who[rows] = np.take_along_axis(names, top, axis=1)
        row, column = np.nonzero(who >= 0)
        found = who[row, column]
        # the score is summed in one order for all, so that equal vectors have equal scores
        score = (given[row] * self.given[found]).sum(axis=1)
        out_row, out_id, out_score = [], [], []
        count = np.minimum(self.starts[found + 1] - self.starts[found], keep)
        for extra in range(keep):
            some = count > extra
            if not some.any():
                break
            out_row.append(row[some])
            out_id.append(self.ids[self.starts[found[some]] + extra])
            out_score.append(score[some])
        if not out_row:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        row, ids, score = map(np.concatenate, (out_row, out_id, out_score))
        other = query_ids[row] != ids
        row, ids, score = row[other], ids[other], score[other]
        order = np.lexsort((ids, -score, row))
        row, ids, score = row[order], ids[order], score[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        return row[place < k], ids[place < k], score[place < k]


def directions(dimensions: int) -> np.ndarray:
    """The same Gaussian matrix in every task."""
    return np.random.default_rng(dimensions).normal(size=(dimensions, PROJECTED))


def nearest(queries: DataFrame, df: DataFrame, k: int = 20, id_col: str = "vec_id",
            vec_col: str = "embedding", block: int = BLOCK, batch: int = BATCH,
            name: str = "nearest") -> DataFrame:
    """(query_id, rank, vec_id, score): the k rows of ``df`` with the largest inner product.

    Nearest first, equal scores by the smaller id; a query does not find its own id.
    Vectors that are null, zero or hold null or non-finite components, and null ids, take
    no part; only vectors with as many components as the query can be found. Of query
    rows that repeat an id one is asked; repeated rows of ``df`` are each found. Fewer
    than k candidates are all returned; an empty side gives no rows. Products beyond the
    range of doubles count as infinite or zero. Other columns are left out.

    Blocks are dealt by a hash of the id, so copies of one vector are spread over all of
    them and are one node in each. A block travels once: its tree is built in the task that
    gets it, and all batches of queries stream past it there. A block answers with at most k
    rows per query.
    """
    vectors = lambda d: d.select(
        F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast("array<double>").alias("vec")
    ).filter(usable("vec") & F.col("id").isNotNull()).withColumn("dim", F.size("vec"))
    asked, given = vectors(queries).dropDuplicates(["id"]), vectors(df)

    def dealt(rows: DataFrame, size: int, key: str) -> DataFrame:
        # one row for each number of components there is; never a join that gathers them
        parts = rows.groupBy("dim").agg(F.ceil(F.count("*") / size).cast("long").alias("parts"))
        numbered = rows.join(F.broadcast(parts), "dim").withColumn(
            key, F.pmod(F.xxhash64("id"), F.col("parts")))
        return packed(numbered, ["dim", key], ["id", "vec"], "rows")

    blocks = materialize(dealt(given, block, "block"), f"{name}-blocks")
    batches_of = materialize(dealt(asked, batch, "batch"), f"{name}-queries")
    trees = blocks.select("dim", "block", F.lit(-1).cast("long").alias("batch"), "rows")
    wanted = blocks.select("dim", "block").join(batches_of, "dim").select(
        "dim", "block", "batch", "rows")
    met = trees.unionByName(wanted).repartition("dim", "block").sortWithinPartitions(
        "dim", "block", "batch")

    def search(batches):
        tree = None
        for part in batches:
            for i in range(part.num_rows):
                rows = rows_of(part.column("rows"), i)
                ids, x = longs(rows, "id"), matrix(rows)
                if part.column("batch")[i].as_py() < 0:
                    tree = Block(ids, x)
                    continue
                row, found, score = tree.search(ids, x, k)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[row]), pa.array(found), pa.array(score)],
                    ["query_id", "vec_id", "score"])

    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (
        met.mapInArrow(search, "query_id long, vec_id long, score double")
        .withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
