"""Script of a name."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def is_latin(name: Column) -> Column:
    """More than 80 % of the characters, spaces and ``-'.`` aside, are Latin letters."""
    counted = F.length(F.regexp_replace(name, r"(?U)[\s\-'.]", ""))
    latin = F.length(F.regexp_replace(name, r"[^A-Za-zÀ-ɏ]", ""))
    return F.when(counted == 0, True).otherwise(latin / counted > 0.8)
