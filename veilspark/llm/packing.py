"""Best-fit packing of token sequences by exact-complement hashing.

Pieces of equal length are interchangeable, so the plan is made over the counts per
length, a table of at most ``capacity`` rows whatever the size of the data. Sums of one,
two and three lengths are looked up for the gap that a longest piece leaves; as many
copies of an exactly filling combination are taken as the counts allow. What is left goes
in by best fit, longest first. A plan line says how many sequences have one combination.
Pieces then find their place by their number among the pieces of their length.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from array import array
from collections.abc import Callable

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame, functions as F

from .common import gapless, map_rows, stored
from .words import ODD, held

Line = tuple[tuple[int, ...], int]  # lengths of one sequence, number of such sequences


def plan_packing(counts: dict[int, int], capacity: int) -> list[Line]:
    """Plan lines that use every piece of ``counts`` (length -> number) once."""
    if any(not 1 <= n <= capacity for n in counts):
        raise ValueError("lengths must be from 1 to the capacity")
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    lines: list[Line] = []

    def take(*lengths: int) -> None:
        need = {n: lengths.count(n) for n in lengths}
        copies = min(int(left[n]) // k for n, k in need.items())
        for n, k in need.items():
            left[n] -= k * copies
        lines.append((lengths, copies))

    for top in range(capacity, 0, -1):
        while left[top] > 0:
            gap = capacity - top
            filling = _complement(left, top, gap)
            if filling is None:
                break
            take(top, *filling)
    lines.extend(_best_fit({int(n): int(left[n]) for n in np.nonzero(left)[0]}, capacity))
    return lines


def _complement(left: np.ndarray, top: int, gap: int) -> tuple[int, ...] | None:
    """None, one, two or three lengths with sum ``gap`` that are there beside ``top``."""
    if gap == 0:
        return ()
    left[top] -= 1
    try:
        if left[gap] > 0:
            return (gap,)
        pair = _pair(left, gap)
        if pair is not None:
            return pair
        for first in range(gap - 2, (gap + 2) // 3 - 1, -1):
            if left[first] > 0:
                left[first] -= 1
                pair = _pair(left, gap - first, first)
                left[first] += 1
                if pair is not None:
                    return (first, *pair)
        return None
    finally:
        left[top] += 1


def _pair(left: np.ndarray, gap: int, most: int | None = None) -> tuple[int, int] | None:
    """The pair of available lengths with sum ``gap`` whose larger one is largest."""
    high = np.arange(min(gap - 1, most or gap), (gap + 1) // 2 - 1, -1)
    if not len(high):
        return None
    low = gap - high
    fits = np.nonzero((left[high] > 0) & (left[low] > (high == low)))[0]
    return (int(high[fits[0]]), int(low[fits[0]])) if len(fits) else None


def _best_fit(counts: dict[int, int], capacity: int) -> list[Line]:
    """Best fit, longest first, for all pieces of one length at a time."""
    open_at: dict[int, list[list]] = {}  # room left -> [lengths, number of sequences]
    done: list[Line] = []

    def put(lengths: tuple[int, ...], copies: int) -> None:
        if copies:
            room = capacity - sum(lengths)
            (open_at.setdefault(room, []) if room else done).append((lengths, copies))

    for length in sorted(counts, reverse=True):
        n = counts[length]
        while n:
            room = min((r for r in open_at if r >= length), default=None)
            if room is None:
                each = capacity // length
                put((length,) * each, n // each)
                put((length,) * (n % each), int(n % each > 0))
                break
            lengths, copies = open_at[room].pop()
            if not open_at[room]:
                del open_at[room]
            used = min(copies, n)
            put(lengths, copies - used)
            put((*lengths, length), used)
            n -= used
    return done + [tuple(line) for lines in open_at.values() for line in lines]


def pack(pieces: DataFrame, capacity: int, length_col: str = "length",
         order: tuple[str, ...] = ("doc_id", "piece")) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` (gapless from 0 in each sequence) to pieces.

    Lengths are from 1 to ``capacity``; no piece is cut here. The driver sees the counts
    per length and the plan, both bounded by the capacity and not by the data. Pieces
    are numbered per (length, writing task), so a length that a third of all pieces have
    is not gathered anywhere. Ties are ordered by ``order``; equal rows are
    interchangeable. An empty table stays empty.
    """
    clash = {"task", "sequence_id", "offset", "_at"} & set(pieces.columns)
    if clash:
        raise ValueError(f"columns {sorted(clash)} would clash")
    rows = stored(pieces, "pieces")
    counts = {r[0]: r[1] for r in rows.groupBy(length_col).count().collect()}
    # One range of numbers for each place of a plan line.
    starts, place, base = [], [], 0
    used: dict[int, int] = {}
    for lengths, copies in plan_packing(counts, capacity):
        offset = 0
        for n in lengths:
            starts.append((n << 44) + used.get(n, 0))
            place.append((base, offset))
            used[n] = used.get(n, 0) + copies
            offset += n
        base += copies
    order_by = np.argsort(np.array(starts, np.int64), kind="stable")
    starts = np.array(starts, np.int64)[order_by]
    place = np.array(place, np.int64).reshape(-1, 2)[order_by]

    @F.pandas_udf("sequence_id long, offset long")
    def locate(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        key = (length.to_numpy(np.int64) << 44) + rank.to_numpy(np.int64)
        at = np.searchsorted(starts, key, side="right") - 1
        return pd.DataFrame({"sequence_id": place[at, 0] + key - starts[at],
                             "offset": place[at, 1]})

    numbered = gapless(rows, [length_col], [F.col(c) for c in order], "_rank_of_length")
    return (
        numbered.withColumn("_at", locate(F.col(length_col).cast("long"), "_rank_of_length"))
        .select(*pieces.columns, "_at.sequence_id", "_at.offset")
    )


#: Latin letters, digits and marks: no two of them compose, each is lowered on its own.
_PLAIN = re.compile("[!-~\xa1-\u012f\u0131-\u024f]+")
_PLAIN_TEXT = re.compile("[\\s!-~\xa1-\u012f\u0131-\u024f]*")
#: Bytes that do not show stand for themselves as letters from 256 on, in their order.
_SHOWN = {b: 256 + i for i, b in enumerate(
    b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174))}


class Recent:
    """Key -> ids, kept in two generations of about ``limit`` keys.

    What is dropped is encoded again when it next occurs, so the bound changes the time
    and never the result.
    """

    def __init__(self, encode: Callable[[list], list[bytes]], limit: int):
        self.encode, self.limit = encode, limit
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def values(self, keys: list[str]) -> list[bytes]:
        """The ids of each key; new ones are encoded together."""
        if len(self.young) > self.limit:
            self.young, self.old = {}, self.young
        got = list(map(self.young.get, keys))
        lost = {k for k, v in zip(keys, got, strict=True) if v is None}
        if not lost:
            return got
        found = {k: v for k in lost if (v := self.old.get(k)) is not None}
        new = list(lost - found.keys())
        found.update(zip(new, self.encode(new), strict=True))
        self.young.update(found)
        return [found[k] if v is None else v for k, v in zip(keys, got, strict=True)]


class WordTokenizer:
    """Ids of words by a tokenizer that drops white space.

    Such a tokenizer splits at white space before it does anything else, so a text's ids
    are those of its words one after the other; other tokenizers are refused. Words are
    kept in a bounded table. A word that is not there is cut as the tokenizer's own file
    says (lower case, classes of characters), and only pieces that are new are encoded.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        for text in ("a b", " a\n\tb ", "A.  1 é"):
            if self.encode([text])[0] != b"".join(self.encode(text.split())):
                raise ValueError(f"{path}: this tokenizer does not drop white space")
        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        normal = _parts(told["normalizer"], "normalizers")
        split, *after = [*_parts(told["pre_tokenizer"], "pretokenizers"), {}]
        self.lower = any(n["type"] == "Lowercase" for n in normal)
        # only then a piece is a pre-token of its own, and its bytes are what the model gets
        known = (
            all(n["type"] in ("NFC", "Lowercase", "Replace") for n in normal)
            and split.get("type") == "Split" and split["behavior"] == "Removed" and split["invert"]
            and "Regex" in split["pattern"] and [x.get("type") for x in after] == ["ByteLevel", None]
            and not after[0]["add_prefix_space"] and not after[0].get("use_regex", True))
        special = [t["content"] for t in told["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.cut = regex.compile(split["pattern"]["Regex"]).findall if known else None
        self.model = self.tokenizer.model
        self.pieces = Recent(self._pieces, limit=200_000)
        self.words = Recent(self._words, limit=200_000)

    def encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for i in range(0, len(texts), 20_000)
                for e in self.tokenizer.encode_batch_fast(texts[i:i + 20_000], add_special_tokens=False)]

    def _pieces(self, pieces: list[str]) -> list[bytes]:
        out, tokenize = [], self.model.tokenize
        for piece in pieces:
            if not piece.isascii():
                piece = piece.encode().decode("latin-1").translate(_SHOWN)
            out.append(array("I", [token.id for token in tokenize(piece)]).tobytes())
        return out

    def _words(self, words: list[str]) -> list[bytes]:
        """Plain words by their pieces, others whole."""
        block = "\n".join(words)
        if self.cut is None:
            plain = [False] * len(words)
        elif _PLAIN_TEXT.fullmatch(block) and not (self.special and self.special.search(block)):
            plain = [True] * len(words)
        else:
            plain = [_PLAIN.fullmatch(w) is not None
                     and not (self.special and self.special.search(w)) for w in words]
        cut = iter(self._by_pieces([w for w, p in zip(words, plain, strict=True) if p]))
        whole = iter(self.encode([w for w, p in zip(words, plain, strict=True) if not p]))
        return [next(cut) if p else next(whole) for p in plain]

    def _by_pieces(self, words: list[str]) -> list[bytes]:
        """All words are cut at once; as pieces cover their words, lengths tell them apart."""
        if not words:
            return []
        block = "\n".join(words)
        pieces = self.cut(block.lower() if self.lower else block)
        ids = self.pieces.values(pieces)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
        covered = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))
        last = np.searchsorted(covered, ends)  # the last piece of each word
        if covered[-1] != ends[-1] or (covered[last] != ends).any():
            raise ValueError("the split pattern leaves out characters that are no white space")
        cuts = [0, *np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)))[last].tolist()]
        line = b"".join(ids)
        return [line[i:j] for i, j in zip(cuts, cuts[1:], strict=False)]

    def texts(self, texts: list[str]) -> list[bytes]:
        """Texts with separators on which Python and the tokenizer disagree go whole."""
        odd = {i for i, t in enumerate(texts) if ODD.search(t)}
        cut = [[] if i in odd else self._lowered(t).split() for i, t in enumerate(texts)]
        ids = self.words.values([w for c in cut for w in c])
        out, at = [], 0
        for i, c in enumerate(cut):
            out.append(self.encode([texts[i]])[0] if i in odd else b"".join(ids[at:at + len(c)]))
            at += len(c)
        return out

    def _lowered(self, text: str) -> str:
        """In lower case, if that is sure to be the tokenizer's: fewer words are new then."""
        if not self.lower or not (text.isascii() or _PLAIN_TEXT.fullmatch(text)):
            return text
        lowered = text.lower()  # special tokens are looked for before
        return text if self.special and self.special.search(lowered) else lowered


def _parts(step: dict | None, name: str) -> list[dict]:
    """The steps of a normalizer or pre-tokenizer."""
    if step is None:
        return []
    return step[name] if step["type"] == "Sequence" else [step]


def encode_texts(texts: list[str], path: str) -> list[bytes]:
    """Ids of texts, with one tokenizer and its tables per worker."""
    return held(("words", path), lambda: WordTokenizer(path)).texts(texts)


def token_pieces(df: DataFrame, tokenizer: str, capacity: int, id_col: str = "doc_id",
                 text_col: str = "text", end_id: int = 0, ids: bool = False) -> DataFrame:
    """(id, piece, start, length, ids_crc32[, ids]) of every whole text.

    A document is its ids and then ``end_id``; only documents longer than ``capacity``
    are cut, into pieces of that length. A null or empty text is the end id alone.
    Repeated rows give repeated pieces; other columns are left out.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    end = struct.pack("<I", end_id)

    def step(group):
        for row, body in zip(group, encode_texts([r["text"] or "" for r in group], tokenizer),
                             strict=True):
            body += end
            for piece, at in enumerate(range(0, len(body), 4 * capacity)):
                cut = body[at:at + 4 * capacity]
                out = {"id": row["id"], "piece": piece, "start": at // 4,
                       "length": len(cut) // 4, "ids_crc32": zlib.crc32(cut)}
                if ids:
                    out["ids"] = cut
                yield out

    schema = (f"id {kind}, piece int, start long, length long, ids_crc32 long"
              + ", ids binary" * ids)
    return map_rows(rows, step, schema, chars=1_000_000, weigh="text").withColumnRenamed(
        "id", id_col)


def pack_documents(df: DataFrame, tokenizer: str, capacity: int = 2048, id_col: str = "doc_id",
                   text_col: str = "text", ids: bool = False) -> DataFrame:
    """Cut and pack whole documents: :func:`token_pieces`, then :func:`pack`."""
    pieces = token_pieces(df, tokenizer, capacity, id_col, text_col, ids=ids)
    return pack(pieces, capacity, order=(id_col, "piece", "start", "ids_crc32"))
