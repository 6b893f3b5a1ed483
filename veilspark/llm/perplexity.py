"""Quality rules: counted rules of a text, and perplexity under a Kneser-Ney model.

The model is one of byte n-grams per language, interpolated modified Kneser-Ney. Spark
counts in how many documents each n-gram of the highest order occurs, over all documents;
the evidence for an n-gram is the number of documents beside one, so no document vouches
for itself and n-grams of a single document do not enter. Lower orders count the distinct
n-grams that end in theirs. Probabilities and back-off weights are worked out as tables; an
n-gram's key is its bytes packed into one number (a hash without collisions), and per order
the keys are kept as a sorted array with the numbers beside them.

Texts are scored in bits a byte (the logarithm of the perplexity). Every language has a
band: the median of its scored texts, wider above and below by its own quartiles. Texts
outside it are rejected. Quartiles come from counts of scores in steps of ``STEP``, which
add up in any order.

A model of at most ``MOST`` entries goes to the tasks as arrays. A larger one stays in
tables: distinct n-grams are looked up by joins, and texts are joined to their n-grams.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window, functions as F

from veilspark.operators.skew import keyed_join
from veilspark.session import materialize

from .common import map_rows
from .words import held

#: Bytes in an n-gram: up to 6, as a batch keeps up to 65,536 documents in the other bits.
ORDER = 5
#: Entries up to which a model is sent to the tasks (about 20 bytes each).
MOST = 4_000_000
#: Steps in which scores are counted for the bands.
STEP = 1 / 1024
#: A band reaches this many quartile distances from the median, and at least ``LEAST`` bits.
WIDTH, LEAST = 8.0, 0.6
#: Bits a byte where nothing is known.
UNKNOWN = 8.0

SYMBOLS = "#*$%&|<>"
WHITE = " \t\n\r\x0b\f"
_WORD = re.compile(r"[^\x20\x09-\x0D]")


def base_rules(text: str | None) -> dict:
    """The counts of the rules for one text; null and empty texts count nothing."""
    text = text or ""
    words = text.encode().split()
    n = len(words)
    seen, again = set(), 0
    for line in text.split("\n"):
        if line in seen:
            again += 1
        elif _WORD.search(line):
            seen.add(line)
    repeated = 0
    if n >= 4:
        ids: dict[bytes, int] = {}
        w = np.fromiter((ids.setdefault(x, len(ids)) for x in words), np.int64, n)
        pairs = w[:-1] * len(ids) + w[1:]
        if len(ids) > 2_000_000:  # three numbers in one would not fit: number the pairs anew
            pairs = np.unique(pairs, return_inverse=True)[1]
        windows = pairs[:-1] * len(ids) + w[2:]
        order = np.sort(windows)
        twice = np.unique(order[1:][order[1:] == order[:-1]])
        if len(twice):
            first = np.isin(windows, twice)
            inside = np.zeros(n, bool)
            for shift in range(3):
                inside[shift:n - 2 + shift] |= first
            repeated = int(inside.sum())
    return {
        "n_words": n, "word_chars": len(text) - sum(map(text.count, WHITE)),
        "n_symbols": sum(map(text.count, SYMBOLS)), "n_dup_lines": again,
        "n_repeat_words": repeated,
    }


BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def spelled(text: str | None) -> bytes:
    """The bytes that are modelled: lower case, words with one space between."""
    return b" ".join((text or "").lower().encode().split())


def grams_of(texts: list[bytes], order: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first text, gram, text number from there, times), each gram of a text once.

    Every byte of a text ends one n-gram; before the first byte stand zero bytes. Texts
    go in groups that fit the bits beside the gram.
    """
    room = min(1 << (64 - 8 * order), 1 << 16)
    for first in range(0, len(texts), room):
        group = texts[first:first + room]
        lengths = np.array([len(t) for t in group])
        pad = b"\0" * (order - 1)
        line = np.frombuffer(pad + pad.join(group), np.uint8)
        ends = np.arange(lengths.sum()) + (order - 1) * (
            1 + np.repeat(np.arange(len(group)), lengths))
        packed = np.zeros(len(line), np.uint64)
        for back in range(order):
            packed[back:] |= line[:len(line) - back].astype(np.uint64) << np.uint64(8 * back)
        keys = (packed[ends] << np.uint64(64 - 8 * order)) | np.repeat(
            np.arange(len(group), dtype=np.uint64), lengths)
        keys.sort()
        cut = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])[:len(keys)])
        times = np.diff(np.append(cut, len(keys)))
        keys = keys[cut]
        text = (keys & np.uint64((1 << (64 - 8 * order)) - 1)).astype(np.int64)
        yield first, keys >> np.uint64(64 - 8 * order), text, times


def _language(lang: str) -> Column:
    return F.coalesce(F.col(lang).cast("string"), F.lit(""))


def _by_language(rows: list[dict]) -> dict[str, list[dict]]:
    groups: dict[str, list[dict]] = {}
    for row in rows:
        groups.setdefault(row["_lang"], []).append(row)
    return groups


def count_grams(docs: DataFrame, text: str = "text", lang: str = "lang", order: int = ORDER
                ) -> DataFrame:
    """(lang, gram, docs): documents with each n-gram of the highest order, written down."""
    if not 2 <= order <= 6:
        raise ValueError("order must be 2 to 6")

    def count(rows):
        for name, own in _by_language(rows).items():
            for _, gram, _, _ in grams_of([spelled(r["_text"]) for r in own], order):
                cut = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]])[:len(gram)])
                for g, n in zip(gram[cut].tolist(), np.diff(np.append(cut, len(gram))).tolist(),
                                strict=True):
                    yield {"lang": name, "gram": g, "docs": n}

    narrow = docs.select(_language(lang).alias("_lang"), F.col(text).alias("_text"))
    return materialize(
        map_rows(narrow, count, "lang string, gram long, docs long", weigh="_text")
        .groupBy("lang", "gram").agg(F.sum("docs").alias("docs")), "grams")


@dataclass
class Model:
    """Tables of a fitted model.

    ``probabilities`` (lang, n, gram, bits) and ``backoffs`` (lang, n, gram, bits): the code
    length of a known n-gram, and what an unknown one with the first n - 1 bytes ``gram`` pays
    before it is looked for one byte shorter.
    """
    order: int
    probabilities: DataFrame
    backoffs: DataFrame
    counts: DataFrame


def _discounts(counted: DataFrame) -> DataFrame:
    """(lang, d1, d2, d3) from how many n-grams have a count of 1, 2, 3 and 4."""
    n = [F.sum((F.col("c") == i).cast("double")).alias(f"n{i}") for i in range(1, 5)]
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))

    def discount(i: int) -> Column:
        fitted = i - (i + 1) * y * F.col(f"n{i + 1}") / F.col(f"n{i}")
        known = (F.col("n1") > 0) & (F.col(f"n{i}") > 0)  # else half of the count
        return F.when(known, F.least(F.greatest(fitted, F.lit(0.0)), F.lit(float(i)))).otherwise(
            F.lit(i / 2)).alias(f"d{i}")

    return counted.groupBy("lang").agg(*n).select("lang", *[discount(i) for i in (1, 2, 3)])


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", order: int = ORDER) -> Model:
    """Count and fit on all rows of ``docs``; null languages are one language of their own."""
    counts = count_grams(docs, text, lang, order)
    tables = [counts.filter("docs > 1").select("lang", "gram", (F.col("docs") - 1).alias("c"))]
    for n in range(order - 1, 0, -1):  # distinct n-grams one byte longer, per ending
        tables.append(materialize(
            tables[-1].groupBy("lang", F.col("gram").bitwiseAND((1 << 8 * n) - 1).alias("gram"))
            .agg(F.count("*").alias("c")), f"grams{n}"))
    shorter, probabilities, backoffs = None, [], []
    for n, table in zip(range(1, order + 1), reversed(tables), strict=True):
        rest = table.join(F.broadcast(_discounts(table)) if n == 1 else _discounts(table), "lang")
        rest = rest.select(
            "lang", "gram", F.shiftright("gram", 8).alias("context"), "c",
            F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2"))
            .otherwise(F.col("d3")).alias("d"))
        # the exact sums do not depend on the order of rows: counts per discount
        contexts = rest.groupBy("lang", "context").agg(
            F.sum("c").alias("total"),
            *[F.sum((F.least("c", F.lit(3)) == i).cast("long")).alias(f"k{i}") for i in (1, 2, 3)],
            *[F.max(F.when(F.least("c", F.lit(3)) == i, F.col("d"))).alias(f"e{i}") for i in (1, 2, 3)])
        weight = sum((F.col(f"k{i}") * F.coalesce(F.col(f"e{i}"), F.lit(0.0)) for i in (1, 2, 3)),
                     F.lit(0.0)) / F.col("total")
        contexts = materialize(
            contexts.select("lang", "context", "total", weight.alias("weight")), f"contexts{n}")
        own = rest.join(contexts, ["lang", "context"])
        if shorter is None:
            below = own.withColumn("below", F.lit(1 / 256))
        else:
            own = own.withColumn("ending", F.col("gram").bitwiseAND((1 << 8 * (n - 1)) - 1))
            below = own.join(shorter.select("lang", F.col("gram").alias("ending"),
                                            F.col("p").alias("below")), ["lang", "ending"])
        p = (F.col("c") - F.col("d")) / F.col("total") + F.col("weight") * F.col("below")
        shorter = materialize(below.select("lang", "gram", p.alias("p")), f"likely{n}")
        probabilities.append(shorter.select(
            "lang", F.lit(n).alias("n"), "gram", (-F.log2("p")).alias("bits")))
        backoffs.append(contexts.select(
            "lang", F.lit(n).alias("n"), F.col("context").alias("gram"),
            (-F.log2("weight")).alias("bits")))
    union = lambda frames: materialize(
        _all(frames).filter("bits is not null"), "model")
    return Model(order, union(probabilities), union(backoffs), counts)


def _all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


class Arrays:
    """Sorted keys with their bits, per language, kind and order."""

    def __init__(self, order: int, columns: dict[tuple, tuple[np.ndarray, np.ndarray]]):
        self.order, self.columns = order, columns

    @classmethod
    def of(cls, model: Model) -> Arrays:
        columns = {}
        for kind, table in (("p", model.probabilities), ("b", model.backoffs)):
            rows = table.toArrow()
            lang = rows["lang"].combine_chunks().dictionary_encode()
            names = lang.dictionary.to_pylist()
            code = lang.indices.to_numpy(zero_copy_only=False)
            n, gram, bits = (rows[c].to_numpy() for c in ("n", "gram", "bits"))
            order = np.lexsort((gram, n, code))
            place = code[order].astype(np.int64) * 8 + n[order]
            for part in np.split(order, np.flatnonzero(np.diff(place)) + 1):
                if len(part):
                    columns[kind, names[code[part[0]]], int(n[part[0]])] = (
                        gram[part].astype(np.uint64), bits[part])
        return cls(model.order, columns)

    def find(self, kind: str, lang: str, n: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(found, bits) for each key."""
        known, bits = self.columns.get((kind, lang, n), (np.empty(0, np.uint64), np.empty(0)))
        if not len(known):
            return np.zeros(len(keys), bool), np.zeros(len(keys))
        at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        found = known[at] == keys
        return found, np.where(found, bits[at], 0.0)

    def bits(self, lang: str, grams: np.ndarray) -> np.ndarray:
        """Code length of the last byte of each n-gram."""
        total, left = np.zeros(len(grams)), np.arange(len(grams))
        for n in range(self.order, 0, -1):
            keys = grams[left] & np.uint64((1 << 8 * n) - 1)
            found, bits = self.find("p", lang, n, keys)
            paid = np.where(found, bits, self.find("b", lang, n, keys >> np.uint64(8))[1])
            total[left] += paid
            left = left[~found]
        total[left] += UNKNOWN
        return total


def score(docs: DataFrame, model: Model, text: str = "text", lang: str = "lang",
          id_col: str = "doc_id", most: int = MOST) -> DataFrame:
    """(id, lang, the base counts, bits): one row per row; ``bits`` is per byte, null without words."""
    kind = docs.select(F.col(id_col)).schema[0].dataType.simpleString()
    narrow = docs.select(F.col(id_col).alias("_id"), _language(lang).alias("_lang"),
                         F.col(text).alias("_text"))
    schema = f"_id {kind}, lang string, {BASE}, bits double"
    if model.probabilities.count() + model.backoffs.count() > most:
        return _score_by_joins(narrow, model, kind).withColumnRenamed("_id", id_col)
    arrays = Arrays.of(model)
    sent = docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, arrays.order, arrays.columns))

    def run(rows):
        name, order, columns = sent.value
        arrays = held(name, lambda: Arrays(order, columns))
        for language, own in _by_language(rows).items():
            texts = [spelled(r["_text"]) for r in own]
            for first, gram, text, times in grams_of(texts, order):
                if len(gram):
                    cut = np.concatenate([[True], gram[1:] != gram[:-1]])
                    bits = arrays.bits(language, gram[cut])[np.cumsum(cut) - 1] * times
                else:
                    bits = np.empty(0)
                group = own[first:first + (1 << 16)]
                total = np.bincount(text, weights=bits, minlength=len(group)).tolist()
                for i, row in enumerate(group):
                    length = len(texts[first + i])
                    yield {"_id": row["_id"], "lang": language, **base_rules(row["_text"]),
                           "bits": total[i] / length if length else None}

    return map_rows(narrow, run, schema, weigh="_text").withColumnRenamed("_id", id_col)


def _score_by_joins(narrow: DataFrame, model: Model, kind: str) -> DataFrame:
    """The same with a model that stays in tables."""
    order = model.order

    def exploded(rows):
        for language, own in _by_language(rows).items():
            texts = [spelled(r["_text"]) for r in own]
            for first, gram, text, times in grams_of(texts, order):
                starts = np.searchsorted(np.sort(text), np.arange(len(texts) + 1))
                by_text = np.argsort(text, kind="stable")
                for i, row in enumerate(own[first:first + (1 << 16)]):
                    mine = by_text[starts[i]:starts[i + 1]]
                    yield {"_id": row["_id"], "lang": language, **base_rules(row["_text"]),
                           "length": len(texts[first + i]), "grams": gram[mine].tolist(),
                           "times": times[mine].tolist()}

    texts = materialize(map_rows(
        narrow, exploded, f"_id {kind}, lang string, {BASE}, length long, "
        "grams array<long>, times array<long>", weigh="_text")
        .withColumn("_row", F.monotonically_increasing_id()), "texts")
    bits = _looked_up(model).withColumn("key", F.struct("lang", "gram")).select("key", "bits")
    rows = texts.select("_row", "lang", F.inline(F.arrays_zip("grams", "times")))
    rows = rows.select("_row", F.struct("lang", F.col("grams").alias("gram")).alias("key"), "times")
    total = (keyed_join(rows, bits, "key", "_row").groupBy("_row")
             .agg(F.sum(F.col("bits") * F.col("times")).alias("total")))
    return texts.join(total, "_row", "left").select(
        "_id", "lang", *[c.split()[0] for c in BASE.split(", ")],
        F.when(F.col("length") > 0, F.col("total") / F.col("length")).alias("bits"))


def _looked_up(model: Model) -> DataFrame:
    """(lang, gram, bits) for every n-gram that any text has."""
    left = model.counts.select("lang", "gram", F.lit(0.0).alias("paid"))
    done = []
    for n in range(model.order, 0, -1):
        # tables of up to two bytes have a proven bound
        small = F.broadcast if n <= 2 else lambda df: df
        known, back = (t.filter(F.col("n") == n).select("lang", F.col("gram").alias(key), F.col("bits").alias(out))
                       for t, key, out in ((model.probabilities, "short", "known"), (model.backoffs, "context", "back")))
        met = materialize(
            left.withColumn("short", F.col("gram").bitwiseAND((1 << 8 * n) - 1))
            .withColumn("context", F.shiftright("short", 8))
            .join(small(known), ["lang", "short"], "left")
            .join(small(back), ["lang", "context"], "left"), "looked-up")
        done.append(met.filter("known is not null").select(
            "lang", "gram", (F.col("paid") + F.col("known")).alias("bits")))
        left = met.filter("known is null").select(
            "lang", "gram", (F.col("paid") + F.coalesce("back", F.lit(0.0))).alias("paid"))
    return _all([*done, left.select("lang", "gram", (F.col("paid") + UNKNOWN).alias("bits"))])


def bands(scored: DataFrame, width: float = WIDTH, least: float = LEAST) -> DataFrame:
    """(lang, low, high) over the rows that pass the base rules, from counts of scores."""
    steps = (scored.filter(~base_failed() & F.col("bits").isNotNull())
             .groupBy("lang", F.floor(F.col("bits") / STEP).alias("step")).agg(F.count("*").alias("n")))
    # scores have at most 64 bits a byte: the steps of a language are a bounded group
    up = Window.partitionBy("lang").orderBy("step")
    steps = steps.withColumn("upto", F.sum("n").over(up)).withColumn(
        "all", F.sum("n").over(Window.partitionBy("lang")))
    quartile = [F.min(F.when(F.col("upto") >= F.col("all") * k / 4, F.col("step"))) * STEP for k in (1, 2, 3)]
    return steps.groupBy("lang").agg(*[q.alias(f"q{k}") for k, q in enumerate(quartile, 1)]).select(
        "lang", (F.col("q2") - F.greatest(width * (F.col("q2") - F.col("q1")), F.lit(least))).alias("low"),
        (F.col("q2") + F.greatest(width * (F.col("q3") - F.col("q2")), F.lit(least))).alias("high"))


def quality(docs: DataFrame, text: str = "text", lang: str = "lang", id_col: str = "doc_id",
            order: int = ORDER, width: float = WIDTH, least: float = LEAST, most: int = MOST) -> DataFrame:
    """(id, lang, base counts, base_failed, bits, kept), one row per row of ``docs``.

    ``kept`` is false for texts that fail the base rules or whose bits a byte lie outside
    the band of their language. Null texts fail the base rules; a language whose texts
    share nothing gives all of them the same bits, so they stay; empty in, empty out.
    """
    model = fit(docs, text, lang, order)
    scored = materialize(score(docs, model, text, lang, id_col, most), "scored")
    return scored.join(F.broadcast(bands(scored, width, least)), "lang", "left").select(
        id_col, "lang", *[c.split()[0] for c in BASE.split(", ")],
        base_failed().alias("base_failed"), "bits",
        (~base_failed() & F.coalesce(F.col("bits").between(F.col("low"), F.col("high")), F.lit(True)))
        .alias("kept"))
