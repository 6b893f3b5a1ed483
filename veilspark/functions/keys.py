"""Mapping keys and the draws derived from them."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def mapping_key(value: Column, entity_type: Column, secret: str = "") -> Column:
    """SHA-256 of ``value|type``; a secret in front stops enumeration of short values."""
    if secret:
        return F.sha2(F.concat(F.lit(secret), value, F.lit("|"), entity_type), 256)
    return F.sha2(F.concat_ws("|", value, entity_type), 256)


def mapping_id(key: Column) -> Column:
    """A stable number for a key; needs no counter."""
    return F.conv(F.substring(key, 1, 15), 16, 10).cast("bigint")


def draw(key: Column, k: int) -> Column:
    """The ``k``-th of eight 32-bit numbers held by a key."""
    return F.conv(F.substring(key, 1 + 8 * k, 8), 16, 10).cast("bigint")


def padded(number: Column, width: int) -> Column:
    return F.lpad(number.cast("string"), width, "0")
