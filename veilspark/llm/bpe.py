"""BPE encoding and decoding by a prefix-sharing trie of distinct words.

The encoding of every prefix of a word ends in one token, and that token fixes the rest:
take it off and the prefix that is left has its own last token. So each node of the trie
of distinct words needs one state, its last token: the token that ends there and may
follow the last token of the node where it starts. Sorted words are that trie in depth-
first order; the stack holds one state per node on the path, and what words have in
common at their beginning is worked out once.

Two neighbouring tokens may stand side by side exactly when plain BPE over the bytes of
both gives these two again. That test is made by merging and remembered per pair.
"""

from __future__ import annotations

import json
import struct
from array import array
from collections.abc import Iterator

import regex
from pyspark.sql import DataFrame, functions as F

from .common import map_rows
from .words import Encodings, held, spaced_chunks

#: How a byte-level vocabulary writes bytes, and where it splits a text.
PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _bytes_of_characters() -> dict[str, int]:
    rest = [b for b in range(256) if b not in set(PRINTABLE)]
    return {chr(b): b for b in PRINTABLE} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBpe:
    """A byte-level BPE vocabulary file; one per worker, see :func:`load`."""

    def __init__(self, path: str, pairs: int = 500_000):
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        spell = _bytes_of_characters()
        raw = lambda s: bytes(spell[c] for c in s)
        special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.vocabulary = {raw(t): i for t, i in data["model"]["vocab"].items()
                           if t not in special}
        self.bytes_of = {i: t for t, i in self.vocabulary.items()}
        self.bytes_of |= {i: t.encode() for t, i in special.items()}
        self.longest = max(map(len, self.vocabulary))
        self.rank: dict[tuple[bytes, bytes], int] = {}
        for n, merge in enumerate(data["model"]["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            self.rank[raw(a), raw(b)] = n
        self.special = special
        self.at_special = regex.compile(
            "(" + "|".join(regex.escape(s) for s in sorted(special, key=len, reverse=True)) + ")"
        ) if special else None
        # \s as the tokenizers have it: without the four separators Python adds
        self.split = regex.compile(SPLIT.replace(r"[^\s", r"[^\s--[\x1c-\x1f]").replace(
            r"\s+", r"[\s--[\x1c-\x1f]]+").replace(r"(?!\S)", r"(?![\S\x1c-\x1f])").replace(
            r"[^\s--[\x1c-\x1f]\p{L}\p{N}]", r"(?:[^\s\p{L}\p{N}]|[\x1c-\x1f])"), regex.V1)
        self.pairs, self.fits = pairs, {}
        self.words = Encodings(self._encode_sorted)
        self.chunks = Encodings(self._encode_chunks)

    def merged(self, word: bytes) -> list[bytes]:
        """Plain BPE: the merge of lowest rank, leftmost first, until none applies."""
        parts = [word[i:i + 1] for i in range(len(word))]
        while len(parts) > 1:
            ranks = [self.rank.get(p) for p in zip(parts, parts[1:], strict=False)]
            best = min((r for r in ranks if r is not None), default=None)
            if best is None:
                break
            i = ranks.index(best)
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def _fit(self, left: bytes, right: bytes) -> bool:
        key = (left, right)
        known = self.fits.get(key)
        if known is None:
            if len(self.fits) >= self.pairs:
                self.fits.clear()
            known = self.merged(left + right) == ([left, right] if left else [right])
            self.fits[key] = known
        return known

    def _encode_sorted(self, words: list[bytes]) -> Iterator[bytes]:
        """Ids (little-endian, 32 bits) of each word; ``words`` is sorted."""
        vocabulary, fit, longest = self.vocabulary, self._fit, self.longest
        last: list[bytes] = []  # the last token of each prefix of the current word
        before = b""
        for word in words:
            shared, most = 0, min(len(word), len(before))
            while shared < most and word[shared] == before[shared]:
                shared += 1
            del last[shared:]
            for end in range(shared + 1, len(word) + 1):
                for start in range(max(0, end - longest), end):
                    token = word[start:end]
                    if token in vocabulary and fit(last[start - 1] if start else b"", token):
                        last.append(token)
                        break
                else:
                    raise ValueError(f"no encoding of {word[:end]!r}")
            before, ids, at = word, [], len(word)
            while at:
                token = last[at - 1]
                ids.append(vocabulary[token])
                at -= len(token)
            ids.reverse()
            yield struct.pack(f"<{len(ids)}I", *ids)

    def _encode_chunks(self, chunks: list[str]) -> Iterator[bytes]:
        cut = [[w.encode() for w in self.split.findall(c)] for c in chunks]
        table = self.words.table({w for words in cut for w in words})
        return (b"".join(map(table.__getitem__, words)) for words in cut)

    def _parts(self, text: str) -> list[str]:
        if self.at_special is None or not any(s in text for s in self.special):
            return [text]
        return self.at_special.split(text)

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of each text; strings of special tokens become those tokens."""
        cut = [[(p, [] if p in self.special else spaced_chunks(p)) for p in self._parts(t)]
               for t in texts]
        table = self.chunks.table({c for parts in cut for _, chunks in parts for c in chunks})
        special = {s: struct.pack("<I", i) for s, i in self.special.items()}
        return [b"".join(special[p] if p in special else b"".join(map(table.__getitem__, chunks))
                         for p, chunks in parts) for parts in cut]

    def decode(self, ids: bytes) -> str:
        """The text of ids; bytes that are no UTF-8 become replacement characters."""
        numbers = array("I", ids) if array("I").itemsize == 4 else struct.unpack(
            f"<{len(ids) // 4}I", ids)
        table = self.bytes_of
        return b"".join([table.get(i, b"") for i in numbers]).decode("utf-8", "replace")


def load(path: str) -> ByteBpe:
    return held(("byte BPE", path), lambda: ByteBpe(path))


def encode(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
           decoded: bool = False) -> DataFrame:
    """(id, ids binary[, decoded string]) of every whole text, one row per input row.

    ``tokenizer`` is the path of a byte-level BPE file on every node. ``ids`` are
    little-endian unsigned 32-bit integers. A null or empty text has no ids and decodes
    to the empty text; repeated rows give repeated rows; an empty table gives an empty
    one; other columns, whatever their names, are left out.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def step(group):
        bpe = load(tokenizer)
        for row, ids in zip(group, bpe.encode_all([r["text"] or "" for r in group]), strict=True):
            out = {"id": row["id"], "ids": ids}
            if decoded:
                out["decoded"] = bpe.decode(ids)
            yield out

    schema = f"id {kind}, ids binary" + ", decoded string" * decoded
    return map_rows(rows, step, schema, chars=2_000_000, weigh="text").withColumnRenamed(
        "id", id_col)


def decode(df: DataFrame, tokenizer: str, id_col: str = "doc_id",
           ids_col: str = "ids") -> DataFrame:
    """(id, text) from ids as :func:`encode` writes them; null ids give the empty text."""
    rows = df.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    kind = rows.schema["id"].dataType.simpleString()

    def step(group):
        bpe = load(tokenizer)
        for row in group:
            yield {"id": row["id"], "text": bpe.decode(row["ids"] or b"")}

    return map_rows(rows, step, f"id {kind}, text string", chars=8_000_000,
                    weigh="ids").withColumnRenamed("id", id_col)
