"""Language ID and sharding against plain second reckonings."""

import math
import random
from collections import Counter

import pytest

from veilspark.llm import langid, sharding


class PlainTree:
    """Code lengths by the definition: the longest context first, escapes with exclusion."""

    def __init__(self, words):
        self.counts = {}
        for word, n in words.items():
            line = b" " + word.encode() + b" "
            for i in range(1, len(line)):
                for k in range(langid.ORDER + 1):
                    if k <= i:
                        self.counts.setdefault(line[i - k:i], Counter())[line[i]] += n

    def word(self, word):
        line, total = b" " + word.encode() + b" ", 0.0
        for i in range(1, len(line)):
            out = set()
            for k in range(min(langid.ORDER, i), -1, -1):
                seen = {s: n for s, n in self.counts.get(line[i - k:i], {}).items() if s not in out}
                if not seen:
                    continue
                units = sum(seen.values()) + len(seen)
                if line[i] in seen:
                    total += math.log2(units / seen[line[i]])
                    break
                total += math.log2(units / len(seen))
                out |= self.counts[line[i - k:i]].keys()
            else:
                total += math.log2(257 - len(out))
        return total


@pytest.fixture
def told(spark):
    rng = random.Random(6)
    words = {"xx": ["kala", "mano", "lakó", "a" * 90], "yy": ["strum", "brick", "grün", "kala"], "zz": ["木木", "水火土金"]}
    rows = [(i, " ".join(rng.choices(words[lang], k=rng.randint(1, 9))), lang)
            for i, lang in enumerate(sorted(words) * 12)]
    # NBSP, other separators, long words without spaces, capitals
    odd = ["a" * 200, "kala\xa0MANO\x85lakó x", "木水" * 300, "strumkala" * 40 + " brick", "İk Σ", "k\x1cb"]
    rows += [(100 + i, t, None) for i, t in enumerate(odd)] + [(200 + i, t, "xx") for i, t in enumerate(odd[:2])]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string"), rows


def test_predictions_equal_plain_code_lengths(told, monkeypatch):
    df, rows = told
    plain = {}
    for lang in ("xx", "yy", "zz"):
        words = Counter()
        for _, t, x in rows:
            if x == lang:
                words.update(t.lower().split())
        plain[lang] = PlainTree(words)
    trees = langid.fit(df)
    for at_once in (langid.AT_ONCE, 7):
        monkeypatch.setattr(langid, "AT_ONCE", at_once)
        model = langid.ContextTrees(dict(zip(trees.languages, trees.trees, strict=True)))
        for _, text, _ in rows:
            costs = {lang: sum(map(tree.word, text.lower().split())) for lang, tree in plain.items()}
            best = min(sorted(costs), key=costs.get)
            share = 1 / sum(2 ** max(-1000, costs[best] - c) for c in costs.values())
            (lang, score), = model.predict([text])
            assert lang == best and score == pytest.approx(share, rel=1e-6)
    got = {r["doc_id"]: r["lang_pred"] for r in langid.predict(df, trees).collect()}
    assert got[102] == "zz" and got[103] == "yy"


def test_long_words_have_no_made_up_ends(told):
    trees = langid.fit(told[0])
    word = "a" * 200
    whole = trees.grams_of(word)
    assert len(whole) == 201 and whole[0] == b" a" and whole[-1] == b"aaaa " and b" a" not in whole[1:]
    assert trees.grams_of(word, 0, 64) + trees.grams_of(word, 64, 64) + trees.grams_of(word, 128) == whole


def test_the_sample_is_bounded_in_bytes(told):
    small = langid.fit(told[0], most_bytes=30)
    assert all(sum(t.get(b"", {}).values()) <= 60 for t in small.trees)


def test_columns_of_the_same_names_make_place(told):
    df, rows = told
    twice = df.withColumn("lang_pred", df.doc_id).withColumn("score", df.text)
    got = langid.predict(twice, langid.fit(df), keep=True)
    assert got.columns == [*df.columns, "lang_pred", "score"] and got.count() == len(rows)


@pytest.mark.parametrize("items", [100_000, 250])
def test_groups_and_bundles(spark, monkeypatch, items):
    """All groups at once, and in bundles: every group once, shards within a hair of each other."""
    rng = random.Random(items)
    sizes = {f"g{i}": rng.choice([1, 2, 5, 30, 200, 3000]) for i in range(600)}
    monkeypatch.setattr(sharding, "ITEMS", items)
    monkeypatch.setattr(sharding, "GROUPS_PER_TASK", 100)
    monkeypatch.setattr(sharding, "PER_SHARD", 40)
    groups = spark.createDataFrame(list(sizes.items()), "item string, size long")
    got = {r["item"]: r["shard"] for r in sharding.assign_groups(groups, 5).collect()}
    assert got.keys() == sizes.keys()
    loads = Counter()
    for item, shard in got.items():
        loads[shard] += sizes[item]
    assert len(loads) == 5 and max(loads.values()) <= 1.05 * min(loads.values())
    if items > 600:
        order = sorted(sizes.items(), key=lambda x: (-x[1], x[0]))
        assert [got[item] for item, _ in order] == sharding.fill_shards([s for _, s in order], 5)
