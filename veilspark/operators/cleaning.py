"""Detect, resolve, substitute and rewrite as one narrow projection per row."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import lru_cache
from typing import Any, NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.arrays import chunks, let, piece, running_sum
from ..functions.keys import mapping_key
from ..functions.patterns import (
    DEFAULT_THRESHOLD,
    ENTITY_TYPES,
    TYPE_RANK,
    Pattern,
    select_patterns,
)
from ..functions.pools import DEFAULT_LOCALE
from ..functions.spans import (
    FOUND,
    PLACED,
    as_spans,
    even_blanks,
    find_any_hits,
    find_cuts,
    find_hits,
    merge_overlaps,
    other_hits,
    parts_if_needed,
    place_spans,
    score_spans,
    single_spans,
    text_shape,
)
from ..functions.strategies import by_type
from .origin import OriginModel


@dataclass(frozen=True)
class CleanConfig:
    """How texts are cleaned. ``strategies`` maps a type to (name, parameters); with ``unique``
    different numbers and addresses always get different substitutes; an ``origin`` model
    chooses persons of the same origin and script."""

    entity_types: list[str] | None = None
    threshold: float = DEFAULT_THRESHOLD
    locale: str = DEFAULT_LOCALE
    secret: str = ""
    strategies: dict[str, tuple[str, dict[str, Any] | None]] = field(default_factory=dict)
    unique: bool = False
    origin: OriginModel | None = None

    def __hash__(self) -> int:
        return hash(repr(self))

    @property
    def types(self) -> list[str]:
        return list(self.entity_types or ENTITY_TYPES)

    @property
    def replaced_types(self) -> list[str]:
        """Types whose values get a mapping."""
        return [t for t in self.types if self.strategies.get(t, ("replace", None))[0] == "replace"]


def with_spans(texts: DataFrame, config: CleanConfig = CleanConfig(), text: str = "text",
               patterns: list[Pattern] | None = None, context: bool = True,
               resolve: bool = True, extra: str | None = None) -> DataFrame:
    """Add ``found`` (all spans at or above the threshold), ``spans`` (overlaps merged) and
    ``parts`` (the text in chunks, for cutting).

    Each step is a column of its own and is used more than once by the next, so
    the optimizer keeps it as a step and the patterns run once.
    """
    chosen = tuple(select_patterns(config.entity_types, config.threshold)
                   if patterns is None else patterns)
    app, base = _application(texts), [c for c in texts.columns if c != extra]
    steps = _steps(app, text, chosen, config.threshold, context)
    rows = computed(computed(texts, shape=text_shape(F.col(text))), **steps.first)
    rows = rows.withColumns(steps.second)
    some, found = (F.size("_singles") > 0) | (F.size("_others") > 0), steps.found
    if extra is not None:
        some = some | (F.coalesce(F.size(extra), F.lit(0)) > 0)
    rows = rows.withColumn("parts", F.when(some, chunks(F.col(text)))).withColumn(
        "_placed", steps.placed)
    if extra is not None:
        found = F.array_sort(F.concat(found, _given_spans(F.col(extra), config)))
    if resolve:
        return computed(rows.withColumn("made", found), found=F.col("made"), spans=_merged(app)
                        ).select(*base, "parts", "found", "spans")
    return computed(rows, found=found).select(*base, "parts", "found")


def _given_spans(extra: Column, config: CleanConfig) -> Column:
    """Spans found elsewhere, of a wanted type and score, in the form of found ones."""
    rank = F.expr("map({})".format(", ".join(f"'{t}', {r}" for t, r in TYPE_RANK.items())))
    wanted = F.filter(extra, lambda s: (s["score"] >= config.threshold)
                      & s["entity_type"].isin(*config.types))
    made = F.transform(wanted, lambda s: F.struct(
        s["start"].cast("int").alias("start"), (-s["end"]).cast("int").alias("neg_end"),
        rank[s["entity_type"]].alias("rank"), s["entity_type"].alias("entity_type"),
        s["score"].cast("double").alias("score"),
        piece(F.col("parts"), s["start"], s["end"]).alias("text")))
    return F.coalesce(made, F.array().cast(f"array<{FOUND}>"))


def computed(df: DataFrame, **columns: Column) -> DataFrame:
    """Add expensive columns behind a one-row generator.

    The optimizer pushes a filter on a plain column below its projection, which
    would run the patterns once for the filter and once more for the result, and
    with steps on top of each other many times over. It does not push a filter on
    a generated column; filters on the other columns still reach the scan. The
    columns are made in a projection, which is compiled, and the generator only hands
    them on: what stands in a generator itself is interpreted.
    """
    made = {name: f"_made_{name}" for name in columns}
    rows = df.select("*", *[c.alias(made[name]) for name, c in columns.items()])
    handed = [F.col(m).alias(name) for name, m in made.items()]
    return rows.select("*", F.inline(F.array(F.struct(*handed)))).drop(*made.values())


def _application(df: DataFrame) -> str:
    return df.sparkSession.sparkContext.applicationId


class _Steps(NamedTuple):
    first: dict[str, Column]
    second: dict[str, Column]
    placed: Column
    found: Column


@lru_cache(maxsize=64)
def _steps(application: str, text: str, chosen: tuple[Pattern, ...], threshold: float,
           context: bool) -> _Steps:
    """The columns of each step. They only name columns, so one set serves all tables of
    an application; putting a large expression together takes longer than planning it.

    Patterns that match once in an ASCII text, which is most of them, take the short way of
    ``single_spans``; the rest is placed and scored by functions over arrays.
    """
    c, patterns = F.col, list(chosen)
    return _Steps(
        {"_cuts": find_cuts(c(text), c("shape"), patterns),
         "_even": F.coalesce(even_blanks(c(text), c("shape")), F.lit(False)),
         "_late": F.when(c("shape").isNull(), find_any_hits(c(text), patterns))},
        {"_singles": single_spans(c("_cuts"), c("_even"), patterns, threshold, context),
         "_others": other_hits(c("_cuts"), c("_even"), c("_late"), patterns)},
        F.when(F.size("_others") > 0, place_spans(c("_others"), patterns)).otherwise(
            F.array().cast(f"array<{PLACED}>")),
        F.when(F.size("_placed") > 0, F.sort_array(F.concat(c("_singles"), score_spans(
            c("_placed"), c("parts"), patterns, threshold, context)))).otherwise(
            F.sort_array("_singles")),
    )


@lru_cache(maxsize=4)
def _merged(application: str) -> Column:
    return merge_overlaps(F.col("made"), F.col("parts"))


def detect(texts: DataFrame, config: CleanConfig = CleanConfig(), text: str = "text",
           patterns: list[Pattern] | None = None, context: bool = True) -> DataFrame:
    """Add ``detections``: every span at or above the threshold, overlaps included."""
    rows = with_spans(texts, config, text, patterns, context, resolve=False)
    return rows.select(*texts.columns, as_spans(F.col("found")).alias("detections"))


def resolved(texts: DataFrame, config: CleanConfig = CleanConfig(), text: str = "text"
             ) -> DataFrame:
    """Add ``spans``: detections with overlaps merged."""
    return with_spans(texts, config, text).select(*texts.columns, "spans")


def explode_spans(df: DataFrame, spans: str, *keep: str) -> DataFrame:
    """One row per span.

    The outer form plus a test afterwards: Spark would otherwise push a size
    filter below the projection and run all patterns twice.
    """
    return (
        df.select(*keep, F.explode_outer(spans).alias("span"))
        .filter(F.col("span").isNotNull())
        .select(
            *keep,
            F.col("span.entity_type").alias("entity_type"),
            F.col("span.start").cast("bigint").alias("start"),
            F.col("span.end").cast("bigint").alias("end"),
            *[F.col(f"span.{c}").alias(c) for c in _extra_fields(df, spans)],
        )
    )


def _extra_fields(df: DataFrame, spans: str) -> list[str]:
    names = df.schema[spans].dataType.elementType.names
    return [n for n in names if n not in ("entity_type", "start", "end")]


def substituted(spans: Column, config: CleanConfig, pinned: Column | None = None,
                given: bool = False, names: Column | None = None) -> Column:
    """Add key and substitute to resolved spans; a pinned substitute wins.

    Without spans ``given`` from elsewhere only types with a pattern can occur. ``names`` has
    a chosen name, or null, at the place of each span.
    """
    chosen = select_patterns(config.entity_types, config.threshold)
    params = {"locale": config.locale, "secret": config.secret,
              "types": config.types if given else [p.entity_type for p in chosen],
              "unique": config.unique}

    def one(s: Column, i: Column | None = None) -> Column:
        key = mapping_key(s["text"], s["entity_type"], config.secret)

        def built(k: Column) -> Column:
            made = by_type(s["text"], s["entity_type"], config.strategies, params | {"key": k})
            if i is not None:
                made = F.coalesce(F.get(names, i), made)
            # a pin replaces a substitute, not a mask, a hash or an empty place
            out = made if pinned is None else F.when(
                s["entity_type"].isin(*config.replaced_types),
                F.coalesce(F.try_element_at(pinned, k), made)).otherwise(made)
            return F.struct(
                s["entity_type"].alias("entity_type"),
                s["start"].alias("start"),
                s["end"].alias("end"),
                s["score"].alias("score"),
                (s["end"] - s["start"]).alias("original_length"),
                k.alias("original_hash"),
                out.alias("substitute"),
            )

        return let(key, built)

    return F.transform(spans, one if names is not None else lambda s: one(s))


def rewrite(text: Column, spans: Column, parts: Column) -> Column:
    """The text with every span replaced by its substitute."""
    pieces = F.transform(
        spans,
        lambda x, i: F.concat(
            piece(parts, F.when(i > 0, F.try_element_at(spans, i)["end"]).otherwise(F.lit(0)),
                  x["start"]),
            x["substitute"],
        ),
    )
    tail = piece(parts, F.element_at(spans, -1)["end"], F.length(text))
    return F.when(F.size(spans) == 0, text).otherwise(F.concat(F.array_join(pieces, ""), tail))


def with_substitutions(texts: DataFrame, config: CleanConfig = CleanConfig(),
                       text: str = "text", pinned: Column | None = None,
                       extra: str | None = None) -> DataFrame:
    """Add ``substitutions`` to what ``with_spans`` adds, for uses that need no new text."""
    rows = with_spans(texts, config, text, extra=extra)
    names = None
    if config.origin is not None and "PERSON" in config.replaced_types:
        persons = F.transform("spans", lambda s: F.when(s["entity_type"] == "PERSON", s["text"]))
        # texts without a person are no work for it
        rows = rows.withColumn("_names", config.origin.names(
            F.when(F.exists("spans", lambda s: s["entity_type"] == "PERSON"), persons), config.secret))
        names = F.col("_names")
    made = (_substituted(_application(texts), config) if pinned is None and extra is None and names is None
            else substituted(F.col("spans"), config, pinned, extra is not None, names))
    return computed(rows, substitutions=made)


def clean_texts(texts: DataFrame, config: CleanConfig = CleanConfig(), text: str = "text",
                pinned: Column | None = None, extra: str | None = None) -> DataFrame:
    """Put ``anonymized_text``, ``substitutions`` and two counters in the place of the text.

    A narrow chain of projections: no shuffle, no Python worker. ``extra`` names a
    column of spans found elsewhere (names, places) to be cleaned as well.
    """
    kept = [c for c in texts.columns if c not in (text, extra)]
    c = F.col
    rows = with_substitutions(texts, config, text, pinned, extra)
    return computed(
        rows, anonymized_text=rewrite(c(text), c("substitutions"), c("parts"))
    ).select(
        *kept, "anonymized_text", "substitutions",
        F.size("found").cast("bigint").alias("entities_detected"),
        F.size("substitutions").cast("bigint").alias("entities_anonymized"),
    )


@lru_cache(maxsize=32)
def _substituted(application: str, config: CleanConfig) -> Column:
    return substituted(F.col("spans"), config)


def clean_arrays(rows: DataFrame, values: str, out: str, config: CleanConfig = CleanConfig()
                 ) -> DataFrame:
    """Add ``out``: the texts of an array column, each cleaned on its own; nulls stay.

    The steps of ``with_spans`` over arrays. Each is a column of its own: nested in one
    expression they take the analyzer a hundred rounds and the driver much memory.
    """
    chosen = select_patterns(config.entity_types, config.threshold)
    step = lambda name: f"_{out}_{name}"
    shapes, hits, parts, placed, found, spans, made = map(
        step, ("shapes", "hits", "parts", "placed", "found", "spans", "made"))
    filled = lambda c, column: F.when(F.size(c) > 0, column)
    steps = computed(rows, **{shapes: F.transform(values, text_shape)})
    steps = computed(steps, **{hits: F.zip_with(values, shapes, lambda v, s: F.when(
        v.isNotNull(), find_hits(v, s, chosen)))})
    steps = computed(steps, **{
        parts: F.zip_with(values, hits, parts_if_needed),
        placed: F.transform(hits, lambda h: filled(h, place_spans(h, chosen)))})
    steps = computed(steps, **{found: F.zip_with(placed, parts, lambda p, t: filled(
        p, score_spans(p, t, chosen, config.threshold)))})
    steps = computed(steps, **{spans: F.zip_with(found, parts, lambda f, t: filled(
        f, merge_overlaps(f, t)))})
    steps = computed(steps, **{made: F.transform(spans, lambda s: filled(
        s, substituted(s, config)))})
    new = F.transform(values, lambda v, i: F.when(F.get(made, i).isNull(), v).otherwise(
        rewrite(v, F.get(made, i), F.get(parts, i))))
    return computed(steps, **{out: new}).select(*rows.columns, out)


def clean_value(value: Column, config: CleanConfig = CleanConfig()) -> Column:
    """The cleaned text of one value as an expression, for use inside arrays."""
    chosen = select_patterns(config.entity_types, config.threshold)

    def after_hits(hits: Column, parts: Column) -> Column:
        found = let(place_spans(hits, chosen), lambda p: score_spans(
            p, parts, chosen, config.threshold))
        spans = let(found, lambda f: merge_overlaps(f, parts))
        return let(substituted(spans, config), lambda s: rewrite(value, s, parts))

    return let(
        let(text_shape(value), lambda shape: find_hits(value, shape, chosen)),
        lambda hits: F.when(F.size(hits) == 0, value).otherwise(
            let(chunks(value), lambda parts: after_hits(hits, parts))),
    )


def output_offsets(substitutions: Column) -> Column:
    """Where each substitute stands in the cleaned text."""
    return let(
        running_sum(F.transform(substitutions,
                                lambda s: F.length(s["substitute"]) - s["original_length"])),
        lambda shift: F.transform(
            substitutions,
            lambda s, i: F.struct(
                s["entity_type"].alias("entity_type"),
                s["start"].alias("start"),
                (s["start"] + shift[i]).alias("out_start"),
                (s["start"] + shift[i] + F.length(s["substitute"])).alias("out_end"),
            ),
        ),
    )


def segments(text: Column, substitutions: Column) -> Column:
    """The cleaned text cut into plain and replaced pieces, in order, none empty."""

    def cut(s: Column, parts: Column) -> Column:
        plain = lambda a, b: F.struct(F.lit(False).alias("replaced"),
                                      piece(parts, a, b).alias("segment"))
        both = F.flatten(F.transform(
            s,
            lambda x, i: F.array(
                plain(F.when(i > 0, F.try_element_at(s, i)["end"]).otherwise(F.lit(0)),
                      x["start"]),
                F.struct(F.lit(True).alias("replaced"), x["substitute"].alias("segment")),
            ),
        ))
        last = F.when(F.size(s) > 0, F.try_element_at(s, F.lit(-1))["end"]).otherwise(F.lit(0))
        return F.filter(F.concat(both, F.array(plain(last, F.length(text)))),
                        lambda x: x["segment"] != "")

    return let(substitutions, lambda s: let(chunks(text), lambda parts: cut(s, parts)))

