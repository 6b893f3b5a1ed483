"""All registered queries."""

from __future__ import annotations

from . import books, cleaning, detection, incremental, records, unique  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
