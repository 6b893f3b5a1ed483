"""Language ID by prediction by partial matching over bytes.

Each language has a context tree: how often each byte followed each context of up to
``ORDER`` bytes. A context ends at the start of its word, so the code length of a word
does not depend on its neighbours. A byte unseen in a context costs an escape (method C:
as many escape counts as distinct followers) and is looked for in the shorter context,
where the bytes of the longer one are excluded; below the empty context all 257 symbols
are alike. Statistics are frozen, so the code length of (context, byte) is one number per
language, kept per distinct gram; words add up their grams and texts their words.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter, defaultdict

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from .common import map_rows
from .words import Encodings, held

ORDER = 4
#: Labelled texts per language that the trees are fitted on, and bytes of them, at most.
PER_LANGUAGE, BYTES_PER_LANGUAGE = 1000, 16_000_000
#: Grams of a long word are added up this many at a time.
AT_ONCE = 100_000
UNKNOWN = "und"
END = b" "


def words_of(text: str) -> list[str]:
    """The words of a text, in lower case."""
    return text.lower().split()


class ContextTrees:
    """The frozen trees of all languages."""

    def __init__(self, counts: dict[str, dict[bytes, dict[int, int]]]):
        self.languages = sorted(counts)
        self.trees = [counts[name] for name in self.languages]
        self.grams = Encodings(self._score_grams)
        self.words = Encodings(self._score_words)

    def bits(self, tree: dict[bytes, dict[int, int]], context: bytes, symbol: int) -> float:
        """Exact code length of one byte after ``context``."""
        cost, excluded = 0.0, ()
        for cut in range(len(context) + 1):
            seen = tree.get(context[cut:])
            if not seen:
                continue
            total, kinds = 0, 0
            for s, n in seen.items():
                if s not in excluded:
                    total += n
                    kinds += 1
            if not kinds:
                continue
            if symbol in seen:
                return cost + math.log2((total + kinds) / seen[symbol])
            cost += math.log2((total + kinds) / kinds)
            excluded = seen
        return cost + math.log2(max(1, 257 - len(excluded)))

    def _score_grams(self, grams: list[bytes]):
        for g in grams:
            yield np.array([self.bits(t, g[:-1], g[-1]) for t in self.trees]).tobytes()

    @staticmethod
    def grams_of(word: str, first: int = 0, most: int | None = None) -> list[bytes]:
        """The grams of a word's bytes, its end included, from byte ``first`` on."""
        b = END + word.encode() + END
        end = len(b) if most is None else min(len(b), 1 + first + most)
        return [b[max(0, i - ORDER):i + 1] for i in range(1 + first, end)]

    def _score_words(self, words: list[str]):
        step, wide = 20_000, len(self.languages)
        for at in range(0, len(words), step):
            part = words[at:at + step]
            # a long word is a run of its own: nothing is cut, its grams come in slices
            cut = [self.grams_of(w) if len(w) <= AT_ONCE else [] for w in part]
            table = self.grams.table({g for grams in cut for g in grams})
            costs = [table[g] for grams in cut for g in grams]
            total = np.zeros((len(part), wide))
            if costs:
                costs = np.frombuffer(b"".join(costs)).reshape(-1, wide)
                short = [i for i, grams in enumerate(cut) if grams]
                starts = np.cumsum([0] + [len(cut[i]) for i in short[:-1]])
                total[short] = np.add.reduceat(costs, starts, axis=0)
            for i, word in enumerate(part):
                if not cut[i]:
                    total[i] = self._score_long(word)
            for row in total:
                yield row.tobytes()

    def _score_long(self, word: str) -> np.ndarray:
        total, first = np.zeros(len(self.languages)), 0
        while grams := self.grams_of(word, first, AT_ONCE):
            table = self.grams.table(set(grams))
            total += np.frombuffer(b"".join(map(table.__getitem__, grams))).reshape(
                -1, len(self.languages)).sum(axis=0)
            first += len(grams)
        return total

    def predict(self, texts: list[str]) -> list[tuple[str, float]]:
        """(language, probability) of each text; ties go to the first name."""
        cut = [words_of(t) if self.languages and any(map(str.isalpha, t)) else []
               for t in texts]
        table = self.words.table({w for words in cut for w in words})
        out = []
        for words in cut:
            if not words:
                out.append((UNKNOWN, 0.0))
                continue
            total = np.frombuffer(b"".join(map(table.__getitem__, words))).reshape(
                -1, len(self.languages)).sum(axis=0)
            best = int(total.argmin())
            share = 1 / np.exp2(np.clip(total[best] - total, -1000, 0)).sum()
            out.append((self.languages[best], float(share)))
        return out


def fit(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        per_language: int = PER_LANGUAGE, most_bytes: int = BYTES_PER_LANGUAGE) -> ContextTrees:
    """Trees from at most ``per_language`` labelled texts a language, whole texts.

    The sample is the texts with the smallest hash of the id, so it is the same on every
    run; it ends before the text that takes it over ``most_bytes``. Words are counted in
    Spark; only (language, word, count) of the sample comes to the driver, and the trees'
    size is bounded by it. Rows with a null id, text or label are left out.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"),
                     F.col(lang_col).alias("lang")).filter(
        "id is not null and text is not null and lang is not null")
    sizes = rows.groupBy("lang").count().collect()
    share = F.lit(0.0)
    for r in sizes:
        share = F.when(F.col("lang") == r["lang"], min(1.0, 2 * per_language / r["count"])
                       ).otherwise(share)
    place = F.pmod(F.xxhash64("id"), F.lit(1_000_003)) / 1_000_003
    picked = (
        rows.filter(place < share)
        .withColumn("n", F.row_number().over(
            Window.partitionBy("lang").orderBy(F.xxhash64("id"), "id", "text")))
        .filter(F.col("n") <= per_language)
        .withColumn("size", F.sum(F.octet_length("text")).over(
            Window.partitionBy("lang").orderBy("n")))
        .filter(F.col("size") <= most_bytes)
    )

    def count(group):
        found = defaultdict(Counter)
        for row in group:
            found[row["lang"]].update(words_of(row["text"]))
        return ({"lang": lang, "word": word, "n": n}
                for lang, words in found.items() for word, n in words.items())

    # words are the same here as when a text is told
    counted = map_rows(picked.select("lang", "text"), count, "lang string, word string, n long",
                       weigh="text").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    trees: dict = {r["lang"]: defaultdict(lambda: defaultdict(int)) for r in sizes}
    for lang, word, n in counted.collect():
        tree = trees[lang]
        for gram in ContextTrees.grams_of(word):
            for cut in range(len(gram)):
                tree[gram[cut:-1]][gram[-1]] += n
    return ContextTrees({lang: {c: dict(s) for c, s in tree.items()}
                         for lang, tree in trees.items()})


def predict(df: DataFrame, trees: ContextTrees, id_col: str = "doc_id",
            text_col: str = "text", keep: bool = False) -> DataFrame:
    """(id, lang_pred, score) of every whole text, row by row.

    Only the text is looked at. A null text, or one without a letter, gives ``und`` and
    score 0; so does every text if there was nothing to learn from. With ``keep`` the
    rows are returned whole, with the two columns added; columns of these names make
    place. Repeated rows stay; an empty table stays empty.
    """
    df = df.drop("lang_pred", "score") if keep else df
    shared = df.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, dict(
        zip(trees.languages, trees.trees, strict=True))))
    rows = df if keep else df.select(F.col(id_col), F.col(text_col))
    fields = rows if keep else rows.select(id_col)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields.schema)

    def step(group):
        for row, (lang, score) in zip(group, _trees(shared).predict(
                [r[text_col] or "" for r in group]), strict=True):
            if not keep:
                row = {id_col: row[id_col]}
            yield row | {"lang_pred": lang, "score": score}

    return map_rows(rows, step, f"{schema}, lang_pred string, score double",
                    chars=2_000_000, weigh=text_col)


def _trees(shared) -> ContextTrees:
    """The trees of a broadcast, made once per worker."""
    name, counts = shared.value
    return held(("trees", name), lambda: ContextTrees(counts))
