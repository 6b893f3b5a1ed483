"""What the two operators over embeddings share: usable vectors, blocks, Arrow to numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

def usable(vec: str) -> Column:
    """Whether a vector is there, not zero, and all of its components are finite."""
    odd = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce(
        F.col(vec).isNotNull() & ~odd & F.exists(vec, lambda x: x != 0), F.lit(False))


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times powers of two, so that squares of huge or tiny components stay in range.

    Products with such a row change by the power alone: which is larger, and every cosine,
    stays as it was. Rows in no danger are left as they are.
    """
    if not x.size:
        return x
    most = np.abs(x).max(axis=1)
    odd = (most > 1e100) | (most < 1e-100)
    return np.ldexp(x, -np.where(odd, np.frexp(most)[1], 0)[:, None]) if odd.any() else x


def packed(df: DataFrame, keys: list[str], fields: list[str], out: str) -> DataFrame:
    """One row per block with its rows as an array; a block has a bounded number of rows."""
    return df.groupBy(*keys).agg(F.collect_list(F.struct(*fields)).alias(out))


def longs(values: pa.StructArray, name: str) -> np.ndarray:
    return values.field(name).to_numpy(zero_copy_only=False).astype(np.int64)


def matrix(values: pa.StructArray, name: str = "vec") -> np.ndarray:
    """The vectors of a block in double precision, one row each."""
    lists = values.field(name)
    flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(lists), -1) if len(lists) else flat.reshape(0, 0)


def rows_of(column: pa.Array, at: int) -> pa.StructArray:
    """The packed rows of one block."""
    return column.slice(at, 1).flatten()
