"""Personal data: four base patterns, and a semi-Markov conditional random field.

The base patterns decide what is surely found. The field reads what they leave: stretches
of words with a digit or an at sign, cut into tokens. A parse of a stretch is a row of
single tokens outside and of whole segments with a kind; a segment is scored by features
of its whole span, and a dynamic program over segments of at most ``LONGEST`` tokens finds
the best parse, which settles boundaries and kinds together. In it a segment has to outweigh
its tokens outside by the odds of ``SURE``.

It learns what values look like when they are not written as the patterns have it: base
matches of a sample are disturbed (no plus sign, other separators, spaced at sign), and
what the patterns leave there as it is stands outside.
"""

from __future__ import annotations

import math
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, functions as F

from .common import map_rows

KINDS = ("email", "ip", "card", "phone")
LONGEST = 16  # tokens of a segment
SURE = 0.95
BLOCK = 512  # tokens whose segments are held at a time
#: Texts that the field is fitted on, stretches of them with a base match and without, at
#: most; longer stretches are cut into windows of so many characters for that.
SAMPLE_TEXTS = 4000
SAMPLE_STRETCHES = 200
WINDOW = 400

# The base patterns in a form that is linear in the text. A match can only start at the
# beginning of a run of digits, and greedy runs that cannot give back are possessive.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9]++(?:[ -][0-9]++)*+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_ODDS = math.log(SURE / (1 - SURE))
_DIGITS = re.compile("[^0-9]+")
_TRIGGER = re.compile("[0-9@]")
_CHUNK = re.compile(r"\S+")
_TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|\s+|.", re.DOTALL)


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        after = at + 1
        if start < at and (m := _DOMAIN.match(text, after)):
            yield start, m.end()
            done = after = m.end()
        else:
            done = after
        at = text.find("@", after)


def base_spans(text: str) -> dict[str, list[tuple[int, int]]]:
    """The base matches of each kind, leftmost and not overlapping within a kind."""
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    if not _TRIGGER.search(text):
        return found
    found["email"] = list(_emails(text))
    found["ip"] = [m.span() for m in _IP.finditer(text) if all(
        len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in m.group().split("."))]
    for m in _CARD.finditer(text):
        digits = _DIGITS.sub("", m.group())
        if 16 <= len(digits) <= 19 and luhn(digits):
            found["card"].append(m.span())
    if "+" in text:
        found["phone"] = [m.span() for m in _PHONE.finditer(text)
                          if 8 <= len(_DIGITS.sub("", m.group())) <= 15]
    return found


def stretches(text: str) -> Iterator[tuple[int, int]]:
    """Spans of neighbouring words that hold a digit or an at sign."""
    done = 0
    for m in _TRIGGER.finditer(text):
        if m.start() < done:
            continue
        start = m.start()
        while start > done and not text[start - 1].isspace():
            start -= 1
        end = _CHUNK.match(text, m.start()).end()
        while end + 1 < len(text) and text[end] == " ":
            after = _CHUNK.match(text, end + 1)
            if after is None or not _TRIGGER.search(after.group()):
                break
            end = after.end()
        # words next to a spaced at sign belong to it
        if text[start] == "@" and start - 2 >= done and text[start - 1] == " ":
            start -= 1
            while start > done and not text[start - 1].isspace():
                start -= 1
        if text[end - 1] == "@" and text[end:end + 1] == " " and (
                after := _CHUNK.match(text, end + 1)):
            end = after.end()
        yield start, end
        done = end


FEATURES = 29
_RUNS = re.compile("[0-9]+")
_SPACED = re.compile(r"[^\s@]+ ?@ ?[^\s@]+")


def features(text: str, start: int, end: int) -> list[float]:
    """What a segment looks like as a whole."""
    s = text[start:end]
    digits = _DIGITS.sub("", s)
    n = len(digits)
    local, at, domain = s.partition("@")
    parts = s.split(".")
    before, after = text[start - 1:start], text[end:end + 1]
    letters = any(map(str.isalpha, s))
    runs = _RUNS.findall(s)
    sizes = [len(r) for r in runs]
    return [float(x) for x in (
        1,
        n == 0, 0 < n < 8, 8 <= n <= 15, 16 <= n <= 19, n > 19,
        16 <= n <= 19 and luhn(digits),
        s.count("@") == 1, bool(at and local and domain),
        bool(at) and "." in domain.strip("."), letters and not at,
        s.startswith("+"), s.startswith("+") and 8 <= n <= 15 and not letters,
        "(" in s and ")" in s, "-" in s,
        len(parts) == 4 and all(p.isascii() and p.isdigit() for p in parts),
        len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p) <= 3 and int(p) <= 255
                                for p in parts),
        " " in s, before.isalnum() or before in ("+", ".", "-", "@", "_", "=", "\""),
        after.isalnum() or after in ("@", "-", "_"),
        s[0] in "+(" or s[0].isalnum(), s[-1].isalnum(),
        not letters and sizes[-3:] == [3, 3, 4] and len(sizes) <= 4 and n <= 13,
        not letters and sizes == [4, 4, 4, 4] and luhn(digits),
        not letters and len(runs) == 4 and all(len(r) <= 3 and int(r) <= 255 for r in runs),
        not letters and len(runs) == 4 and len(set(_RUNS.sub("0", s).strip("0").split("0"))) == 1
        and max(sizes) <= 3,
        bool(_SPACED.fullmatch(s)) and bool(re.search(r"\.[A-Za-z]{2,}$", s)),
        after in (".", "-", "/", "_", "[") and text[end + 1:end + 2].isalnum(),
        start > 1 and before in (".", "-", "/", "_", "(", "]") and text[start - 2].isalnum(),
    )]


@dataclass
class Stretch:
    """The tokens of one free stretch and its candidate segments."""

    text: str
    tokens: list[tuple[int, int]]
    ends: list[list[tuple[int, int]]] = field(default_factory=list)  # by end: (start, row)
    rows: list[list[float]] = field(default_factory=list)

    @classmethod
    def of(cls, text: str, start: int, end: int) -> Stretch:
        tokens = [m.span() for m in _TOKEN.finditer(text, start, end)]
        out = cls(text, tokens, [[] for _ in range(len(tokens) + 1)])
        held = [bool(_TRIGGER.search(text[a:b])) for a, b in tokens]
        blank = [text[a].isspace() for a, b in tokens]
        for i in range(len(tokens)):
            if blank[i]:
                continue
            some = False
            for j in range(i, min(len(tokens), i + LONGEST)):
                some = some or held[j]
                if some and not blank[j]:
                    out.ends[j + 1].append((i, len(out.rows)))
                    out.rows.append(features(text, tokens[i][0], tokens[j][1]))
        return out


class SegmentField:
    """Weights (features x kinds) and exact inference over all parses of a stretch."""

    def __init__(self, weights: np.ndarray | None = None):
        self.weights = np.zeros((FEATURES, len(KINDS))) if weights is None else weights

    def shares(self, stretch: Stretch) -> tuple[np.ndarray, float]:
        """The share of all parses of each (segment, kind), and the log of the total."""
        n = len(stretch.tokens)
        scores = np.array(stretch.rows).reshape(-1, FEATURES) @ self.weights
        whole = np.logaddexp.reduce(scores, axis=1).tolist() if len(scores) else []
        forward, backward = [0.0] * (n + 1), [0.0] * (n + 1)
        for j in range(1, n + 1):
            forward[j] = _log_sum([forward[j - 1]] + [
                forward[i] + whole[r] for i, r in stretch.ends[j]])
        starts: list[list[tuple[int, int]]] = [[] for _ in range(n + 1)]
        for j, ends in enumerate(stretch.ends):
            for i, r in ends:
                starts[i].append((j, r))
        for i in range(n - 1, -1, -1):
            backward[i] = _log_sum([backward[i + 1]] + [
                backward[j] + whole[r] for j, r in starts[i]])
        around = np.empty((len(scores), 1))
        for j, ends in enumerate(stretch.ends):
            for i, r in ends:
                around[r] = forward[i] + backward[j]
        return np.exp(scores + around - forward[n]), forward[n]

    def fit(self, data: list[tuple[Stretch, dict[tuple[int, int], int]]], rounds: int = 30,
            rate: float = 2.0, decay: float = 1e-4) -> SegmentField:
        """Climb the likelihood of the labelled parses (token span -> kind)."""
        squares = np.full_like(self.weights, 1e-8)
        for _ in range(rounds):
            slope = -decay * len(data) * self.weights
            for stretch, gold in data:
                if not stretch.rows:
                    continue
                expected, _ = self.shares(stretch)
                target = np.zeros_like(expected)
                for j, ends in enumerate(stretch.ends):
                    for i, r in ends:
                        if (i, j) in gold:
                            target[r, gold[i, j]] = 1.0
                slope += np.array(stretch.rows).T @ (target - expected)
            squares += slope ** 2
            self.weights += rate * slope / np.sqrt(squares)
        return self

    def parse(self, text: str, start: int, end: int, block: int = BLOCK
              ) -> list[tuple[str, int, int]]:
        """The segments of the best parse of text[start:end], by their start.

        The segments that start in ``block`` tokens are held at a time; of the others two
        numbers and a kind a token stay. Of equal parses the one with more outside wins.
        """
        cuts = array("q", [start])
        cuts.extend(m.end() for m in _TOKEN.finditer(text, start, end))
        n = len(cuts) - 1
        best = array("d", [0.0]) + array("d", [-math.inf]) * n
        came, kind = array("q", [-1]) * (n + 1), bytearray(n + 1)
        for low in range(0, n, block):
            where, ends, scores, kinds = self._segments(text, cuts, low, min(n, low + block))
            at = 0
            for i in range(low, min(n, low + block)):
                while at < len(where) and where[at] == i:
                    j, score = ends[at], best[i] + scores[at]
                    if score > best[j]:
                        best[j], came[j], kind[j] = score, i, kinds[at]
                    at += 1
                if best[i] >= best[i + 1]:
                    best[i + 1], came[i + 1] = best[i], -1
        found, j = [], n
        while j > 0:
            if came[j] >= 0:
                found.append((KINDS[kind[j]], cuts[came[j]], cuts[j]))
                j = came[j]
            else:
                j -= 1
        return found[::-1]

    def _segments(self, text: str, cuts: array, low: int, high: int):
        """First token, end, score beyond the odds and kind of segments from [low, high)."""
        where, ends, rows = [], [], []
        n = len(cuts) - 1
        for i in range(low, high):
            if text[cuts[i]].isspace():
                continue
            some = False
            for j in range(i, min(n, i + LONGEST)):
                token = text[cuts[j]:cuts[j + 1]]
                some = some or bool(_TRIGGER.search(token))
                if some and not token[0].isspace():
                    where.append(i)
                    ends.append(j + 1)
                    rows.append(features(text, cuts[i], cuts[j + 1]))
        scores = np.array(rows).reshape(-1, FEATURES) @ self.weights
        return where, ends, (scores.max(axis=1) - _ODDS).tolist(), scores.argmax(axis=1).tolist()

    def more(self, text: str, taken: list[tuple[int, int]]) -> Iterator[tuple[str, int, int]]:
        """Segments of the text outside the spans ``taken``, sorted by their start."""
        near = 0
        for start, end in stretches(text):
            at = start
            while near < len(taken) and taken[near][0] < end:
                a, b = taken[near]
                if at < a and _TRIGGER.search(text, at, a):
                    yield from self.parse(text, at, a)
                at = max(at, min(b, end))
                if b > end:  # reaches over the stretch: the next one meets it too
                    break
                near += 1
            if at < end and _TRIGGER.search(text, at, end):
                yield from self.parse(text, at, end)


def _log_sum(values: list[float]) -> float:
    top = max(values)
    return top + math.log(sum([math.exp(v - top) for v in values]))


def all_spans(text: str, model: SegmentField) -> list[tuple[str, int, int, bool]]:
    """(kind, start, end, base) of a text, by kind as listed and then by start."""
    base = base_spans(text)
    out = [(k, a, b, True) for k in KINDS for a, b in base[k]]
    if _TRIGGER.search(text):
        taken = sorted((a, b) for _, a, b, _ in out)
        out += [(k, a, b, False) for k, a, b in model.more(text, taken)]
        out.sort(key=lambda s: (KINDS.index(s[0]), s[1], s[2]))
    return out


def disturbed(kind: str, value: str) -> list[str]:
    """Ways to write a base match that no base pattern has."""
    if kind == "phone":
        bare = value[1:]
        return [bare, "00" + bare, re.sub("[-.]", " ", bare), re.sub("[- ]", ".", bare)]
    if kind == "card":
        digits = _DIGITS.sub("", value)
        groups = [digits[i:i + 4] for i in range(0, len(digits), 4)]
        return [mark.join(groups) for mark in (".", "/", "_", ", ")]
    if kind == "ip":
        return [value.replace(".", mark) for mark in ("[.]", "(.)", ",", "-")]
    name, _, domain = value.partition("@")
    return [f"{name} @ {domain}", f"{name}@ {domain}", f"{name} @{domain}"]


def _labelled(text: str, spans: list[tuple[int, int, str]]) -> list[tuple[Stretch, dict]]:
    """The stretches of a text with the given spans as gold segments."""
    out = []
    for start, end in stretches(text):
        stretch = Stretch.of(text, start, end)
        first = {a: i for i, (a, _) in enumerate(stretch.tokens)}
        last = {b: i + 1 for i, (_, b) in enumerate(stretch.tokens)}
        out.append((stretch, {
            (first[a], last[b]): KINDS.index(kind) for a, b, kind in spans
            if a in first and b in last and last[b] - first[a] <= LONGEST}))
    return out


def examples(piece: str) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """A piece with its base matches disturbed, each way in turn, and its new spans.

    Matches that overlap another one are left out of it; what a base pattern still finds
    after being disturbed is masked, as it is when a text is read.
    """
    spans = sorted((a, b, k) for k in KINDS for a, b in base_spans(piece)[k])
    if any(x[1] > y[0] for x, y in zip(spans, spans[1:], strict=False)):
        return []
    out = []
    for way in range(4 if spans else 1):
        text, new, done = "", [], 0
        for a, b, kind in spans:
            ways = disturbed(kind, piece[a:b])
            text += piece[done:a]
            new.append((len(text), len(text) + len(ways[way % len(ways)]), kind))
            text += ways[way % len(ways)]
            done = b
        text += piece[done:]
        base = [x for k in KINDS for x in base_spans(text)[k]]
        if not any(a < y and x < b for a, b, _ in new for x, y in base):
            for a, b in base:
                text = text[:a] + " " * (b - a) + text[b:]
            out.append((text, new))
    return out


def windows(text: str, start: int, end: int, size: int) -> Iterator[tuple[int, int]]:
    """A stretch in parts of at most ``size`` characters, cut at a space where there is one."""
    while end - start > size:
        cut = text.rfind(" ", start + 1, start + size)
        cut = start + size if cut < 0 else cut
        yield start, cut
        start = cut
    yield start, end


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
        texts: int = SAMPLE_TEXTS, most: int = SAMPLE_STRETCHES, window: int = WINDOW
        ) -> SegmentField:
    """A field fitted on stretches of at most ``texts`` texts, labelled by the base patterns.

    The texts are those with the smallest hash of the id among about as many, the
    stretches, ``most`` with a base match and ``most`` without, those with the smallest
    hash of their characters, in windows of ``window`` characters with the word on either
    side; these bounds are parameters. Nothing to learn from gives a field that adds nothing.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    n = rows.count()
    share = min(1.0, texts / n) if n else 0.0
    picked = rows.filter(
        F.pmod(F.xxhash64("id"), F.lit(1_000_003)) / 1_000_003 < share).filter(
        F.col("text").rlike("[0-9@]"))

    def step(group):
        for row in group:
            text = row["text"]
            for a, b in stretches(text):
                for start, end in windows(text, a, b, window):
                    piece = text[max(0, text.rfind(" ", max(0, start - 30), max(0, start - 1)) + 1):end]
                    more = _CHUNK.match(text, end + 1, end + 31)
                    piece += text[end:more.end()] if more else ""
                    yield {"piece": piece, "based": any(base_spans(piece).values())}

    found = map_rows(picked.select("text"), step, "piece string, based boolean", weigh="text").distinct()
    data = []
    for based in (True, False):
        sample = found.filter(F.col("based") == based).orderBy(
            F.xxhash64("piece"), "piece").limit(most).collect()
        data += [x for r in sample for text, spans in examples(r["piece"]) for x in _labelled(text, spans)]
    return learned(data)


def learned(data: list[tuple[Stretch, dict[tuple[int, int], int]]]) -> SegmentField:
    """A field fitted to labelled stretches; without a segment among them one that adds nothing."""
    return SegmentField().fit(data) if any(gold for _, gold in data) else SegmentField()


def find(df: DataFrame, model: SegmentField, id_col: str = "doc_id",
         text_col: str = "text") -> DataFrame:
    """(id, spans) with all spans of every whole text, offsets in code points.

    ``spans`` is an array of (kind, start, end, base), by kind as listed in ``KINDS`` and
    then by start; ``base`` tells the base matches, all of which stay. A null or empty
    text has none; repeated rows stay; other columns are left out; an empty table stays
    empty.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    weights = model.weights

    def step(group):
        field = SegmentField(weights)
        for row in group:
            yield {"id": row["id"], "spans": [
                {"kind": k, "start": a, "end": b, "base": base}
                for k, a, b, base in all_spans(row["text"] or "", field)]}

    return map_rows(
        rows, step,
        f"id {kind}, spans array<struct<kind: string, start: int, end: int, base: boolean>>",
        weigh="text").withColumnRenamed("id", id_col)


def redact_text(text: str | None, model: SegmentField) -> str | None:
    """The text with every span (overlapping ones as one) replaced by its kind."""
    if not text:
        return text
    out, done = [], 0
    for kind, a, b, _ in sorted(all_spans(text, model), key=lambda s: (s[1], -s[2])):
        if a >= done:
            out += [text[done:a], f"<{kind.upper()}>"]
        done = max(done, b)
    return "".join([*out, text[done:]])


def redact(df: DataFrame, model: SegmentField, text_col: str = "text") -> DataFrame:
    """The rows whole, with spans of the text replaced by ``<KIND>``; null stays null."""
    weights = model.weights

    def step(group):
        field = SegmentField(weights)
        for row in group:
            yield row | {text_col: redact_text(row[text_col], field)}

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return map_rows(df, step, schema, weigh=text_col)
