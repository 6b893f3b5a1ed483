"""Spans: where in a text a sensitive value stands.

A span is ``struct<entity_type, start, end, score, text>`` with half-open code
point offsets. All functions take and return columns, so detection is a narrow
projection: no shuffle, no Python worker.
"""

from __future__ import annotations

from decimal import ROUND_HALF_UP, Decimal
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, functions as F

from .arrays import by_name, chunks, let, piece, running_max, running_sum
from .checks import luhn_ok, mod97_ok
from .patterns import (
    CONTEXT_BOOST,
    CONTEXT_FLOOR,
    CONTEXT_TOKENS,
    CONTEXT_WORDS,
    ENTITY_TYPES,
    SHAPE,
    TYPE_RANK,
    Pattern,
)

SPAN = "struct<entity_type:string,start:int,end:int,score:double,text:string>"
FOUND = (
    "struct<start:int,neg_end:int,rank:int,entity_type:string,score:double,text:string>"
)
_STRETCHES = (100, 4000)  # characters before a span, tried in turn before the whole text
PLACED = (
    "struct<start:int,neg_end:int,rank:int,entity_type:string,score:double,raised:double,text:string>"
)
_FEW = 4  # spans of a text that are merged without functions over arrays
_MARK = "\x01"
_CHECKS = {"luhn": luhn_ok, "mod97": mod97_ok}
_HIT = "struct<pattern:int,pieces:array<string>>"


def text_shape(text: Column) -> Column:
    """The text with one sign for each kind of character (``SHAPE``): a byte search in it tells
    which patterns can match at all. Null, so that all are tried, unless the text is ASCII."""
    plain = (F.octet_length(text) == F.length(text)) & ~F.contains(text, F.lit(_MARK))
    return F.when(plain, F.translate(text, *SHAPE))


def _pieces(text: Column, number: int, p: Pattern) -> Column:
    """Gaps and matches of one pattern in turn, a gap at both ends; null when there is none."""
    test = text.rlike(p.java)
    if p.must_contain:
        test = F.contains(text, F.lit(p.must_contain)) & test
    values = F.regexp_extract_all(text, F.lit(p.java), F.lit(0))
    # the last gap has no match behind it
    return F.when(test, _hit(number, F.array_compact(F.flatten(
        F.zip_with(_gaps(text, p), values, lambda g, v: F.array(g, v))))))


def _hit(number: int, pieces: Column) -> Column:
    return F.struct(F.lit(number).alias("pattern"), pieces.alias("pieces"))


def _gaps(text: Column, p: Pattern) -> Column:
    """The text between the matches.

    ``split`` compiles its pattern for every row, ``regexp_replace`` once per task:
    matches become a mark first, and the split is on the mark. A text that holds
    the mark itself is split by the pattern.
    """
    marked = F.split(F.regexp_replace(text, F.lit(p.java), F.lit(_MARK)), _MARK, -1)
    return F.when(F.contains(text, F.lit(_MARK)), F.split(text, p.java, -1)).otherwise(marked)


def _plain_pieces(text: Column, shape: Column, number: int, p: Pattern) -> Column:
    """The same for an ASCII text without the mark: one pass puts a mark around every match.
    Without a match there is one piece."""
    tests, cut = _tests(text, shape, p), _hit(number, _marked(text, p))
    return F.when(reduce(or_, tests), cut) if tests else cut


def _cut(text: Column, shape: Column, p: Pattern) -> Column:
    """The pieces alone."""
    tests, cut = _tests(text, shape, p), _marked(text, p)
    return F.when(reduce(or_, tests), cut) if tests else cut


def _marked(text: Column, p: Pattern) -> Column:
    return F.split(F.regexp_replace(text, F.lit(p.ascii), F.lit(f"{_MARK}$0{_MARK}")), _MARK, -1)


def _tests(text: Column, shape: Column, p: Pattern) -> list[Column]:
    tests = [F.contains(shape, F.lit(x)) for x in p.shapes]
    return tests or ([F.contains(text, F.lit(p.must_contain))] if p.must_contain else [])


def find_cuts(text: Column, shape: Column, chosen: list[Pattern]) -> Column:
    """Step 1 for an ASCII text without the mark: the pieces that each pattern cuts it into, in
    the order of the patterns, without functions over arrays, so that it is compiled."""
    if not chosen:
        return F.array().cast("array<array<string>>")
    return F.when(shape.isNotNull(), F.array(*[
        _cut(text, shape, p) for p in chosen]))


def even_blanks(text: Column, shape: Column) -> Column:
    """Whether words of an ASCII text are set apart by single spaces."""
    return ~F.contains(shape, F.lit("  ")) & ~text.rlike(r"[\t-\r]")


def single_spans(cuts: Column, even: Column, chosen: list[Pattern], threshold: float,
                 context: bool = True) -> Column:
    """Steps 3 and 4 for patterns that match once in a text with even blanks: the first piece is
    the text before the span and its last words are the context. Only what depends on the text is
    left to work out, and no function over arrays is needed."""
    none = F.array().cast(f"array<{FOUND}>")

    def spans(i: int, p: Pattern) -> Column:
        cut = F.get(cuts, F.lit(i))
        before, v = F.get(cut, F.lit(0)), F.get(cut, F.lit(1))
        low, high = float(_rounded(p.score)), float(_rounded(_raised(p)))

        def made(score: Column) -> Column:
            return F.array(F.struct(
                F.length(before).alias("start"), (-(F.length(before) + F.length(v))).alias("neg_end"),
                F.lit(TYPE_RANK[p.entity_type]).alias("rank"), F.lit(p.entity_type).alias("entity_type"),
                score.alias("score"), v.alias("text")))

        test = F.size(cut) == 3
        if p.checksum:
            test = test & _CHECKS[p.checksum](v)
        if not (context and p.context):
            return F.when(test, made(F.lit(low))).otherwise(none) if low >= threshold else none
        words = F.lower(F.substring_index(F.trim(before), " ", -CONTEXT_TOKENS))
        helped = words.rlike("|".join(_shortest(p.context)))
        if low >= threshold:
            return F.when(test, made(F.when(helped, high).otherwise(low))).otherwise(none)
        return F.when(test & helped, made(F.lit(high))).otherwise(none) if high >= threshold else none

    return F.when(even, F.flatten(F.array(*[spans(i, p) for i, p in enumerate(chosen)]))
                  ).otherwise(none) if chosen else none


def other_hits(cuts: Column, even: Column, late: Column, chosen: list[Pattern]) -> Column:
    """The hits that ``single_spans`` leaves, in the form of ``find_hits``."""
    none = F.array().cast(f"array<{_HIT}>")

    def hit(i: int) -> Column:
        cut = F.get(cuts, F.lit(i))
        return F.when((F.size(cut) > 3) | ((F.size(cut) == 3) & ~even),
                      F.array(_hit(i, cut))).otherwise(none)

    return F.coalesce(late, F.flatten(F.array(*[hit(i) for i in range(len(chosen))]))
                      ) if chosen else none


def _shortest(words: tuple[str, ...]) -> list[str]:
    """Lower case, without words that hold another one: a search finds the same texts."""
    low = list(dict.fromkeys(w.lower() for w in words))
    return [w for w in low if not any(v != w and v in w for v in low)]


def _raised(p: Pattern) -> float:
    return min(max(p.score + CONTEXT_BOOST, CONTEXT_FLOOR), 1.0)


def _labels(patterns: list[Pattern]) -> Column:
    """Type, rank and score of each pattern, without and with context: a constant."""
    rows = ", ".join(
        f"named_struct('entity_type', '{p.entity_type}', 'rank', {TYPE_RANK[p.entity_type]}, "
        f"'score', {_rounded(p.score)}D, 'raised', "
        f"{_rounded(_raised(p))}D)" for p in patterns)
    return F.expr(f"array({rows})")


def _rounded(score: float) -> str:
    """Four digits, halves up, as ``round`` of a column has them."""
    return str(float(Decimal(repr(float(score))).quantize(Decimal("0.0001"), ROUND_HALF_UP)))


def _spans_of_hits(hit: Column, labels: Column) -> Column:
    label, pieces = labels[hit["pattern"]], hit["pieces"]

    def span(start: Column, v: Column) -> Column:
        return F.struct(
            start.alias("start"),
            (-(start + F.length(v))).alias("neg_end"),
            label["rank"].alias("rank"),
            label["entity_type"].alias("entity_type"),
            label["score"].alias("score"),
            label["raised"].alias("raised"),
            v.alias("text"),
        )

    several = let(running_sum(F.transform(pieces, F.length)), lambda starts: F.transform(
        F.sequence(F.lit(1), F.size(pieces) - 2, F.lit(2)),
        lambda i: span(F.get(starts, i), F.get(pieces, i))))
    # most patterns match once: no running sum is needed
    return F.when(F.size(pieces) == 3, F.array(span(
        F.length(F.get(pieces, F.lit(0))), F.get(pieces, F.lit(1))))).otherwise(several)


def context_window(parts: Column, start: Column) -> Column:
    """The last words before a span, lower case, one space between.

    A short stretch is looked at first. If it does not hold one word more than needed,
    so that the last ones are surely whole, a longer one is, and then all of the text.
    """

    def words(length: int | None) -> Column:
        low = F.lit(0) if length is None else F.greatest(start - length, F.lit(0))
        return F.filter(F.split(piece(parts, low, start), r"\s+"), lambda w: w != "")

    def enough(lengths: tuple[int, ...]) -> Column:
        if not lengths:
            return words(None)
        return let(words(lengths[0]), lambda w: F.when(
            (F.size(w) > CONTEXT_TOKENS) | (start <= lengths[0]), w).otherwise(
            enough(lengths[1:])))

    return F.lower(F.array_join(
        let(enough(_STRETCHES),
            lambda w: F.slice(w, F.greatest(F.size(w) - CONTEXT_TOKENS + 1, F.lit(1)),
                              F.lit(CONTEXT_TOKENS))), " "))


def has_context(window: Column, entity_type: Column, types: set[str]) -> Column:
    """Whether the window holds a context word of the type."""
    tests = {t: window.rlike("|".join(w.lower() for w in CONTEXT_WORDS[t]))
             for t in ENTITY_TYPES if t in types and t in CONTEXT_WORDS}
    return by_name(entity_type, tests, F.lit(False))


def _checked(spans: Column, patterns: list[Pattern]) -> Column:
    kinds = {p.entity_type: p.checksum for p in patterns if p.checksum}
    if not kinds:
        return spans

    def passes(s: Column) -> Column:
        ok = None
        for name, kind in kinds.items():
            test = _CHECKS[kind](s["text"])
            ok = (
                F.when(s["entity_type"] == name, test)
                if ok is None
                else ok.when(s["entity_type"] == name, test)
            )
        return ok.otherwise(F.lit(True))

    return F.filter(spans, passes)


def find_hits(text: Column, shape: Column, chosen: list[Pattern]) -> Column:
    """Step 1: for each pattern with a match the pieces it cuts the text into."""
    none = F.array().cast(f"array<{_HIT}>")
    if not chosen:
        return none
    quick = F.filter(F.array(*[_plain_pieces(text, shape, i, p) for i, p in enumerate(chosen)]),
                     lambda h: h.isNotNull() & (F.size(h["pieces"]) > 1))
    return F.when(shape.isNotNull(), quick).otherwise(find_any_hits(text, chosen))


def find_any_hits(text: Column, chosen: list[Pattern]) -> Column:
    """Step 1 for a text of any letters."""
    none = F.array().cast(f"array<{_HIT}>")
    always = [_pieces(text, i, p) for i, p in enumerate(chosen) if not p.has_digit]
    with_digit = [_pieces(text, i, p) for i, p in enumerate(chosen) if p.has_digit]
    groups = [F.array(*always)] if always else []
    if with_digit:
        groups.append(F.when(text.rlike(r"(?U)\d"), F.array(*with_digit)).otherwise(none))
    return F.array_compact(F.concat(*groups))


def parts_if_needed(text: Column, hits: Column) -> Column:
    """Step 2: the text in chunks, only where something was found."""
    return F.when(F.size(hits) > 0, chunks(text))


def place_spans(hits: Column, chosen: list[Pattern]) -> Column:
    """Step 3: spans with offsets that pass their check digits, without context yet."""
    if not chosen:
        return F.array().cast(f"array<{PLACED}>")
    labels = _labels(chosen)
    return _checked(F.flatten(F.transform(hits, lambda h: _spans_of_hits(h, labels))), chosen)


def score_spans(spans: Column, parts: Column, chosen: list[Pattern], threshold: float,
                context: bool = True) -> Column:
    """Step 4: scores raised by context, spans below the threshold dropped, sorted."""
    types = {p.entity_type for p in chosen if p.context}

    def scored(s: Column) -> Column:
        score = s["score"]
        if context and types:
            # nothing stands before a span at the start
            score = F.when(F.when(
                (s["start"] > 0) & s["entity_type"].isin(*sorted(types)),
                let(context_window(parts, s["start"]),
                    lambda w: has_context(w, s["entity_type"], types)),
            ), s["raised"]).otherwise(score)
        return F.struct(*[(score if name == "score" else s[name]).alias(name) for name in (
            "start", "neg_end", "rank", "entity_type", "score", "text")])

    return F.sort_array(
        F.filter(F.transform(spans, scored), lambda s: s["score"] >= threshold))


def merge_overlaps(found: Column, parts: Column) -> Column:
    """Step 5: overlapping spans become one, so that every character is in at most one.

    Spans that overlap form an island. It covers all their characters and takes
    the label of its longest member, then the surest, then the lowest type rank:
    a contained span disappears in its container, and the tail of a partial
    overlap is never left exposed. Spans that only touch stay apart.
    """

    def island(members: Column) -> Column:
        start = members[0]["start"]
        summed = F.struct(
            F.array_min(
                F.transform(
                    members,
                    lambda m: F.struct(
                        (m["neg_end"] + m["start"]).alias("neg_length"),
                        (-m["score"]).alias("neg_score"),
                        m["rank"].alias("rank"),
                        m["entity_type"].alias("entity_type"),
                    ),
                )
            ).alias("best"),
            (-F.array_min(F.transform(members, lambda m: m["neg_end"]))).alias("end"),
        )
        return let(
            summed,
            lambda i: F.struct(
                i["best"]["entity_type"].alias("entity_type"),
                start.alias("start"),
                i["end"].alias("end"),
                (-i["best"]["neg_score"]).alias("score"),
                piece(parts, start, i["end"]).alias("text"),
            ),
        )

    def merged(heads: Column) -> Column:
        return F.transform(
            heads,
            lambda lo, j: island(F.slice(
                found, lo + 1,
                F.when(j + 1 < F.size(heads), F.try_element_at(heads, j + 2))
                .otherwise(F.size(found)) - lo)),
        )

    reach = running_max(F.transform(found, lambda m: -m["neg_end"]))
    heads = let(reach, lambda r: F.filter(F.sequence(F.lit(0), F.size(found) - 1),
                                          lambda i: found[i]["start"] >= r[i]))
    # spans are sorted by start: where none begins before the end of the one ahead, all stay
    apart = ~F.exists(F.sequence(F.lit(1), F.size(found) - 1), lambda i: (
        found[i]["start"] < -found[i - 1]["neg_end"]))
    few = F
    for n in range(1, _FEW + 1):  # tested one by one, without functions over arrays
        free = [F.get(found, F.lit(i))["start"] >= -F.get(found, F.lit(i - 1))["neg_end"]
                for i in range(1, n)]
        few = few.when(reduce(and_, free, F.size(found) == n), F.array(*[
            _as_span(F.get(found, F.lit(i))) for i in range(n)]))
    return (
        few.when((F.size(found) > _FEW) & apart, as_spans(found))
        .when(F.size(found) > 0, let(heads, merged))
        .otherwise(F.array().cast(f"array<{SPAN}>")))


def as_spans(found: Column) -> Column:
    """Found spans in their outside form."""
    return F.transform(found, _as_span)


def _as_span(s: Column) -> Column:
    return F.struct(
        s["entity_type"].alias("entity_type"),
        s["start"].alias("start"),
        (-s["neg_end"]).alias("end"),
        s["score"].alias("score"),
        s["text"].alias("text"),
    )
