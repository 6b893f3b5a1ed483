"""Splitting texts where a tokenizer always splits, and encodings kept per distinct piece."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

#: Python counts these four as white space, the tokenizers do not.
ODD = re.compile("[\x1c-\x1f]")
_SPACED = re.compile(r"\s*\S+|\s+")
_SPACED_ODD = re.compile(r"[^\S\x1c-\x1f]*(?:\S|[\x1c-\x1f])+|[^\S\x1c-\x1f]+")


def spaced_chunks(text: str) -> list[str]:
    """Runs of white space with the word after them: no token reaches over their ends."""
    return (_SPACED_ODD if ODD.search(text) else _SPACED).findall(text)


_HELD: dict = {}


def held(key: object, make: Callable[[], object]) -> object:
    """The model of this worker; another one takes its place, tables and all."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = make()
    return _HELD[key]


class Encodings:
    """Piece -> value, filled in batches by ``encode`` and kept in two generations.

    At most ``2 * limit`` pieces are held: when the young generation is full it becomes
    the old one. What is dropped is encoded again when it next occurs, so the bound
    changes the time and never the result.
    """

    def __init__(self, encode: Callable[[list], Iterable], limit: int = 200_000):
        self.encode, self.limit = encode, limit
        self.young: dict = {}
        self.old: dict = {}

    def table(self, pieces: set) -> dict:
        """A mapping that holds every one of ``pieces``."""
        if len(self.young) > self.limit:
            self.young, self.old = {}, self.young
        young, old = self.young, self.old
        new = pieces - young.keys()
        kept = new & old.keys()
        young.update((p, old[p]) for p in kept)
        new -= kept
        if new:
            order = sorted(new)
            young.update(zip(order, self.encode(order), strict=True))
        return young
