"""Spelling variants: words one edit apart, found by blocked Gram matrices of letter counts.

Words one inserted, deleted or replaced letter apart have letter counts at a squared
distance of 1 (lengths differ by one) or 2 (same length). Letters are dealt into a few
groups; words with the same counts per group, hence of one length, make a block. An edit
moves a word by one step in one group (insertion) or one step down in one group and up in
another (replacement), so a block meets itself and a fixed number of blocks of its own and
the next length. Blocks are cut into tiles of a bounded number of words; two tiles that
meet are one row of a join, and one matrix product gives all squared distances between
them. Pairs at most two apart are verified letter by letter.

How letters are grouped changes the time and never the result. Memory of a task is bounded
by the tiles it looks at. Nothing is capped: a block of many tiles is many rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from veilspark.session import materialize

from .common import map_rows

#: Maximal runs of Latin letters, and the only letters that are lowered.
RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = {upper: upper + 32 for upper in range(ord("A"), ord("Z") + 1)}

#: Words in a tile.
TILE = 1024

#: Letters that the driver may deal by their frequency; others go by their code point.
DEALT = 256


def word_counts(docs: DataFrame, text: str = "text", id_col: str = "doc_id", least: int = 7,
                edit: Callable[[object, str], str] | None = None) -> DataFrame:
    """(word, n): the lowered runs of all texts with at least ``least`` letters.

    ``edit(id, word)`` may replace a run before it is counted; it must depend on nothing
    else. Texts that are null or have no run count nothing; repeated rows count again.
    """
    def count(rows):
        total: Counter = Counter()
        for row in rows:
            if row["_text"]:
                own = Counter(RUN.findall(row["_text"].translate(LOWER)))
                if edit is not None:
                    changed: Counter = Counter()
                    for word, n in own.items():
                        changed[edit(row["_id"], word)] += n
                    own = changed
                for word, n in own.items():
                    if len(word) >= least:
                        total[word] += n
        return ({"word": w, "n": n} for w, n in total.items())

    narrow = docs.select(F.col(id_col).alias("_id"), F.col(text).alias("_text"))
    return (map_rows(narrow, count, "word string, n long", weigh="_text")
            .groupBy("word").agg(F.sum("n").alias("n")))


def variants(words: DataFrame, ratio: int = 10, tile: int = TILE) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every row of ``words`` (word, n).

    ``form`` is the near word of largest n (ties: smallest in code-point order) if that n
    is at least ``ratio`` times the word's own, else null with ``form_n``; ``root`` is
    where following forms ends (the word itself without one). Words are distinct and not
    null or empty; an empty table gives an empty one. ``ratio`` is above 1, so that forms
    rise in n and chains end.
    """
    if ratio <= 1:
        raise ValueError("ratio must be above 1")
    words = materialize(words.select("word", "n"), "words")
    best = (
        near_pairs(words, tile).groupBy("word")
        .agg(F.count("*").alias("n_near"),
             F.min(F.struct((-F.col("near_n")).alias("m"), F.col("near").alias("w"))).alias("b"))
    )
    near = words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(-F.col("b.m") >= ratio * F.col("n"), F.col("b")).alias("b"))
    near = materialize(near.select(
        "word", "n", "n_near", F.col("b.w").alias("form"), (-F.col("b.m")).alias("form_n")), "near")
    roots = _roots(near.filter("form is not null").select("word", F.col("form").alias("root")))
    return near.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _roots(links: DataFrame) -> DataFrame:
    """Each word's last form: every round doubles the number of steps taken."""
    links = materialize(links, "forms")
    while True:
        step = links.select(F.col("word").alias("root"), F.col("root").alias("_further"))
        moved = materialize(
            links.join(step, "root", "left")
            .select("word", F.coalesce("_further", "root").alias("root"),
                    F.col("_further").isNotNull().alias("moved")), "forms")
        if moved.filter("moved").isEmpty():
            return moved.drop("moved")
        links = moved.drop("moved")


def near_pairs(words: DataFrame, tile: int = TILE, groups: int | None = None) -> DataFrame:
    """(word, near, near_n): both directions of every pair of words one edit apart.

    The number of letter groups follows the number of words, so that blocks stay small.
    """
    groups = groups or max(4, round(math.log2(words.count() + 1) / 3))
    dealt = _dealt(words, groups)
    keyed = map_rows(
        words, lambda rows: ({**r, "key": _written(_counts(r["word"], dealt, groups))} for r in rows),
        "word string, n long, key string", weigh="word")
    tiles = materialize(
        keyed.hint("rebalance", "key").mapInArrow(lambda b: _packed(b, tile), TILES), "tiles")
    home = tiles.select("key", F.col("tile").alias("home"), F.col("letters").alias("own_letters"),
                        F.col("words").alias("own_words"), F.col("ns").alias("own_ns"))
    return (
        home.join(tiles.mapInArrow(_sent, TILES), "key")
        # the tiles of one block meet in one direction
        .filter(~F.col("inside") | (F.col("home") <= F.col("tile")))
        .select("home", "own_letters", "own_words", "own_ns", "tile", "letters", "words", "ns")
        .mapInArrow(_compared, "word string, near string, near_n long")
    )


#: The words of a tile have one length, so they are kept joined, their counts as binary.
TILES = "key string, tile long, inside boolean, letters int, words string, ns binary"
_TILES = pa.schema([("key", pa.string()), ("tile", pa.int64()), ("inside", pa.bool_()),
                    ("letters", pa.int32()), ("words", pa.string()), ("ns", pa.binary())])
_PAIRS = pa.schema([("word", pa.string()), ("near", pa.string()), ("near_n", pa.int64())])


def _dealt(words: DataFrame, groups: int) -> dict[str, int]:
    """Letter -> group, groups of about equal weight. At most ``DEALT`` rows are collected."""
    found = (
        words.select(F.explode(F.split("word", "")).alias("letter")).filter("letter != ''")
        .groupBy("letter").count().orderBy(F.desc("count"), "letter").limit(DEALT).collect()
    )
    weight = [0] * groups
    dealt = {}
    for row in found:
        dealt[row["letter"]] = weight.index(min(weight))
        weight[dealt[row["letter"]]] += row["count"]
    return dealt


def _counts(word: str, dealt: dict[str, int], groups: int) -> list[int]:
    counts = [0] * groups
    for letter in word:
        group = dealt.get(letter)
        counts[ord(letter) % groups if group is None else group] += 1
    return counts


def _written(counts: list[int]) -> str:
    return ",".join(map(str, counts))


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(schema)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t.type) for c, t in zip(columns, schema, strict=True)], schema=schema)


def _packed(batches, tile: int, most: int = 500_000):
    """Words of a block gathered into tiles; all are handed on when ``most`` are held."""
    from pyspark import TaskContext

    number = TaskContext.get().partitionId() << 33
    held: dict[str, tuple[list, list]] = defaultdict(lambda: ([], []))
    size = 0

    def handed(keys):
        nonlocal number
        rows = []
        for key in keys:
            words, ns = held.pop(key)
            rows.append((key, number, True, len(words[0]), "".join(words),
                         np.array(ns, "<i8").tobytes()))
            number += 1
        return _rows(rows, _TILES)

    for batch in batches:
        full = []
        for word, n, key in zip(*(batch.column(c).to_pylist() for c in ("word", "n", "key")),
                                strict=True):
            words, ns = held[key]
            words.append(word)
            ns.append(n)
            size += 1
            if len(words) == tile:
                full.append(handed([key]))
                size -= tile
        yield from full
        if size > most:
            yield handed(list(held))
            size = 0
    if held:
        yield handed(list(held))


def _sent(batches):
    """Each tile goes to its own block and to those that an edit leads to from there."""
    out: list[tuple] = []
    for batch in batches:
        for key, tile, _, letters, words, ns in zip(
                *(c.to_pylist() for c in batch.columns), strict=True):
            counts = list(map(int, key.split(",")))
            targets = [(key, True)]
            for i, count in enumerate(counts):
                if count:
                    counts[i] -= 1
                    targets.append((_written(counts), False))  # a letter less
                    for j in range(i + 1, len(counts)):
                        counts[j] += 1
                        targets.append((_written(counts), False))  # another letter there
                        counts[j] -= 1
                    counts[i] += 1
            out += [(k, tile, inside, letters, words, ns) for k, inside in targets]
            if len(out) > 2000:
                yield _rows(out, _TILES)
                out = []
    yield _rows(out, _TILES)


def _compared(batches, most: int = 8192):
    """Near pairs of each home tile with the tiles that were sent to its block."""
    for batch in batches:
        out: list[tuple] = []
        homes, tiles = (batch.column(c).to_numpy() for c in ("home", "tile"))
        letters, words, ns = (batch.column(c).to_pylist() for c in ("letters", "words", "ns"))
        cuts = np.flatnonzero(np.concatenate([[True], homes[1:] != homes[:-1], [True]])[:len(homes) + 1])
        for first, end in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            length, text, n = (
                batch.column(c)[first].as_py() for c in ("own_letters", "own_words", "own_ns"))
            own = _Words(length, [text], [n])
            guests: dict[int, tuple[list, list]] = defaultdict(lambda: ([], []))
            for i in range(first, end):
                if tiles[i] == homes[i]:
                    _near(own, own, out, itself=True)
                    continue
                texts, numbers = guests[letters[i]]
                texts.append(words[i])
                numbers.append(ns[i])
                if sum(map(len, numbers)) >= 8 * most:
                    _near(own, _Words(letters[i], *guests.pop(letters[i])), out)
            for length, (texts, numbers) in guests.items():
                _near(own, _Words(length, texts, numbers), out)
            if len(out) > 50_000:
                yield _rows(out, _PAIRS)
                out = []
        yield _rows(out, _PAIRS)


class _Words:
    """Words of one length as a matrix of code points, with their letter counts."""

    def __init__(self, letters: int, texts: list[str], ns: list[bytes]):
        self.letters, self.text = letters, "".join(texts)
        self.n = np.frombuffer(b"".join(ns), "<i8")
        self.codes = np.frombuffer(self.text.encode("utf-32-le"), "<u4").reshape(-1, letters)
        # letters 64 code points apart share a column: distances can only shrink
        cells = (np.arange(len(self.codes))[:, None] * 64 + self.codes % 64).ravel()
        counts = np.bincount(cells, minlength=len(self.codes) * 64).reshape(-1, 64)
        self.counts = counts.astype(np.float32 if letters < 2000 else np.float64)  # exact
        self.squares = (self.counts ** 2).sum(axis=1, keepdims=True)
        self.ones = np.ones_like(self.squares)

    def word(self, i: int) -> str:
        return self.text[i * self.letters:(i + 1) * self.letters]


def _near(a: _Words, b: _Words, out: list[tuple], itself: bool = False) -> None:
    """Both directions of the near pairs between ``a`` and ``b`` (as long, or one longer)."""
    left = np.hstack([-2 * a.counts, a.squares, a.ones])
    right = np.hstack([b.counts, b.ones, b.squares])
    at, to = np.nonzero(left @ right.T <= 2)
    if itself:
        at, to = at[at < to], to[at < to]
    step = max(1, 4_000_000 // b.letters)
    for k in range(0, len(at), step):
        i, j = at[k:k + step], to[k:k + step]
        if a.letters == b.letters:
            near = (a.codes[i] != b.codes[j]).sum(axis=1) == 1
        else:  # the shorter one is a start and an end of the longer one
            x, y = a.codes[i], b.codes[j]
            start = np.logical_and.accumulate(x == y[:, :-1], axis=1).sum(axis=1)
            end = np.logical_and.accumulate((x == y[:, 1:])[:, ::-1], axis=1).sum(axis=1)
            near = start + end >= a.letters
        for p, q in zip(i[near].tolist(), j[near].tolist(), strict=True):
            one, two = a.word(p), b.word(q)
            out.append((one, two, int(b.n[q])))
            out.append((two, one, int(a.n[p])))
