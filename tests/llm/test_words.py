"""Spelling variants, quality rules and periodic runs against plain second reckonings."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest

from veilspark.llm import periodic, perplexity, queries, spelling

ODD = [None, "", " ", "\t\n", "a", "x\x1cy \x85 nbsp\xa0em", "été ÉTÉ Été", "z" * 5000,
       "ab " * 3000, "no no no no no no", "a b a b a b a b a b c", "one two three " * 40]


def table(spark, texts, langs=None):
    """Null and repeated ids, and columns that clash with inner names."""
    langs = langs or [None, "en"]
    rows = [(i if i else None, t, langs[i % len(langs)], 1, "x", 0.5, "w") for i, t in enumerate(texts)]
    rows.append(rows[3])
    return spark.createDataFrame(
        rows, "doc_id long, text string, lang string, n long, _row string, bits double, word string"
    ).repartition(3)


# spelling variants


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if len(a) > len(b):
        a, b = b, a
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain_variants(counts, ratio):
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * counts[w] else None
    out = set()
    for w, n in counts.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.add((w, form[w], root, n, len(near[w]), counts[form[w]] if form[w] else None))
    return out


def made_words(seed, n):
    rng = random.Random(seed)
    words = ["information", "informatian", "éléments", "ÿÿÿÿÿÿÿÿ", "a" * 300, "a" * 301, "a" * 302,
             "abcdefgh", "abcdefg", "bcdefgh", "hgfedcba", "日本語日本語日本"]
    while len(words) < n:
        w = list(rng.choice(words))
        for _ in range(rng.randint(1, 2)):
            i = rng.randrange(len(w))
            w[i:i + rng.randint(0, 1)] = rng.choice(["", "x", "é", "e", "zz"])
        if len(w) > 3:
            words.append("".join(w))
    return {w: rng.choice([1, 2, 3, 30, 300, 4000]) for w in words}


@pytest.mark.parametrize("tile, groups", [(1024, None), (3, 1), (2, 6)])
def test_variants_equal_brute_force(spark, tile, groups, monkeypatch):
    counts = made_words(tile, 250)
    monkeypatch.setattr(spelling, "DEALT", 5)
    words = spark.createDataFrame(list(counts.items()), "word string, n long")
    if groups:
        got = {(r["word"], r["near"], r["near_n"])
               for r in spelling.near_pairs(words, tile, groups).collect()}
        assert got == {(a, b, counts[b]) for a in counts for b in counts if one_edit(a, b)}
        return
    got = spelling.variants(words, 10, tile).collect()
    assert len(got) == len(counts)
    assert {tuple(r) for r in got} == plain_variants(counts, 10)


def test_forms_are_followed_to_the_end(spark):
    chain = [("abcdefgh"[:i] + "x" * (8 - i), 10 ** i) for i in range(9)]
    got = {r["word"]: r["root"] for r in spelling.variants(
        spark.createDataFrame(chain, "word string, n long")).collect()}
    assert set(got.values()) == {"abcdefgh"}


def test_spelling_query(spark, tmp_path):
    rng = random.Random(4)
    words = ["Éléments", "elements", "elementes", "paragraph", "paragraf", "ABCDEFG", "short"]
    texts = ODD + [" ".join(rng.choices(words, [9, 50, 2, 40, 3, 9, 9], k=60)) + "1Éparagraph_x" for _ in range(60)]
    docs = table(spark, texts)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    counts = Counter()
    for r in docs.collect():
        for w in re.findall("[A-Za-zÀ-ÿ]+", r["text"] or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w)
            h = zlib.crc32(f"{r['doc_id']}:{w}".encode())
            if r["doc_id"] is not None and h % 31 == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            counts[w] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    assert len(counts) > 8
    got = queries.op11_spelling(spark, str(tmp_path)).collect()
    assert len(got) == len(counts) and {tuple(r) for r in got} == plain_variants(counts, 10)


def test_spelling_of_nothing(spark):
    empty = table(spark, ODD).limit(0)
    assert spelling.variants(spelling.word_counts(empty)).count() == 0


# quality rules


def plain_rules(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, again = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            again += line in seen
            seen.add(line)
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    often = {w for w, n in Counter(windows).items() if n > 1}
    inside = {i + k for i, w in enumerate(windows) if w in often for k in range(3)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), again, len(inside))


def test_base_rules():
    rng = random.Random(2)
    for _ in range(300):
        text = "".join(rng.choices(["a", "b", " ", "\n", "é", "$", "\x1c", "\t"], [5, 2, 6, 2, 1, 1, 1, 1],
                                   k=rng.randint(0, 80)))
        assert tuple(perplexity.base_rules(text).values()) == plain_rules(text)
    for text in ODD:
        assert tuple(perplexity.base_rules(text).values()) == plain_rules(text)


class PlainModel:
    """Interpolated modified Kneser-Ney over bytes, by dictionaries and recursion."""

    def __init__(self, texts, order):
        docs = Counter()
        for t in texts:
            line = b"\0" * (order - 1) + t
            docs.update({line[i - order:i] for i in range(order, len(line) + 1)})
        self.order = order
        self.c = {order: {g: n - 1 for g, n in docs.items() if n > 1}}
        for n in range(order - 1, 0, -1):
            self.c[n] = Counter(g[1:] for g in self.c[n + 1])
        self.children = {n: defaultdict(list) for n in self.c}
        for n, counted in self.c.items():
            for g, c in counted.items():
                self.children[n][g[:-1]].append(c)

    def discount(self, n, c):
        k = Counter(self.c[n].values())
        i = min(c, 3)
        if not k[1] or not k[i]:
            return i / 2
        y = k[1] / (k[1] + 2 * k[2])
        return min(max(i - (i + 1) * y * k[i + 1] / k[i], 0.0), i)

    def p(self, gram):
        n = len(gram)
        if n == 0:
            return 1 / 256
        counts = self.children[n].get(gram[:-1])
        if not counts:
            return self.p(gram[1:])
        spare = sum(self.discount(n, c) for c in counts) / sum(counts)
        c = self.c[n].get(gram, 0)
        return (c - self.discount(n, c) if c else 0) / sum(counts) + spare * self.p(gram[1:])

    def bits(self, text):
        line = b"\0" * (self.order - 1) + text
        return sum(-math.log2(self.p(line[i - self.order:i])) for i in range(self.order, len(line) + 1)) / len(text)


@pytest.fixture(scope="module")
def prose(spark):
    rng = random.Random(5)
    syllables = {"en": ["the", "ing", "er", "on", "at", "or", "ha"], "de": ["ein", "der", "ung", "schö", "zu"]}
    texts, langs = list(ODD), ["en", "de"]
    for i in range(90):
        part = syllables[langs[(i + len(ODD)) % 2]]
        texts.append(" ".join("".join(rng.choices(part, k=rng.randint(1, 3))) for _ in range(70)))
    texts.append(" ".join("".join(rng.choices("qxzjkvw!?0123456789", k=9)) for _ in range(70)))
    return table(spark, texts, langs)


@pytest.mark.parametrize("most", [perplexity.MOST, 0])
def test_perplexity_equals_a_plain_model(spark, prose, most):
    groups = defaultdict(list)
    rows = prose.collect()
    for r in rows:
        groups[r["lang"] or ""].append(perplexity.spelled(r["text"]))
    models = {lang: PlainModel(texts, 3) for lang, texts in groups.items()}
    model = perplexity.fit(prose, order=3)
    got = perplexity.score(prose, model, most=most).collect()
    want = []
    for r in rows:
        text = perplexity.spelled(r["text"])
        want.append((r["doc_id"] or -1, *plain_rules(r["text"]),
                     models[r["lang"] or ""].bits(text) if text else -1.0))
    got = [(r["doc_id"] or -1, *(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines",
                                                "n_repeat_words")),
            -1.0 if r["bits"] is None else r["bits"]) for r in got]
    for a, b in zip(sorted(got), sorted(want), strict=True):
        assert a[:-1] == b[:-1] and a[-1] == pytest.approx(b[-1], abs=1e-6)


def test_probabilities_add_up_to_one(prose):
    texts = [perplexity.spelled(r["text"]) for r in prose.filter("lang = 'de'").collect()]
    model = PlainModel(texts, 3)
    for context in (b"ei", b"qq", b"\0\0"):
        assert sum(model.p(context + bytes([b])) for b in range(256)) == pytest.approx(1)


def test_bands_reject_noise_and_keep_prose(spark, prose):
    got = {r["doc_id"]: r for r in perplexity.quality(prose).collect()}
    noise = max(i for i in got if i is not None)
    assert not got[noise]["kept"] and not got[noise]["base_failed"]
    clean = [r for i, r in got.items() if i is not None and len(ODD) <= i < noise]
    assert len(clean) == 90 and all(r["kept"] for r in clean)
    assert not any(r["kept"] for r in got.values() if r["base_failed"])
    assert perplexity.quality(prose.limit(0)).count() == 0


def test_bands_are_quartiles_of_all_scores(spark):
    rng = np.random.default_rng(3)
    bits = np.round(rng.normal(2, .2, 999) / perplexity.STEP) * perplexity.STEP
    scored = spark.createDataFrame(
        [("en", 100, 0, float(b)) for b in bits], "lang string, n_words long, n_repeat_words long, bits double")
    low, high = perplexity.bands(scored, 3.0, 0.0).select("low", "high").head()
    q = [np.quantile(bits, k / 4, method="inverted_cdf") for k in (1, 2, 3)]
    assert low == pytest.approx(q[1] - 3 * (q[1] - q[0])) and high == pytest.approx(q[1] + 3 * (q[2] - q[1]))


# periodic runs


def plain_runs(words, least=6, times=4):
    n, out = len(words), []
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if j > i and length >= max(least, times * q):
                run = words[i:i + length]
                if not any(run[d:] == run[:-d] for d in range(1, q)):
                    out.append((i, length, q))
            i = j + 1
    return sorted(out)


def made_text(rng):
    n, kinds, words = rng.randint(0, 130), rng.choice([1, 2, 3, 8]), []
    while len(words) < n:
        if rng.random() < .4:
            part = [rng.choice("abcdefgh"[:kinds]) for _ in range(rng.randint(1, 14))]
            words += (part * rng.randint(1, 9))[:rng.randint(1, 90)]
        else:
            words.append(rng.choice("abcdefghijkl"[:kinds + 3]))
    return " ".join(words[:n])


@pytest.mark.parametrize("whole", [periodic.WHOLE, 5])
def test_periodic_runs_equal_brute_force(spark, whole, monkeypatch):
    monkeypatch.setattr(periodic, "SPAN", 16)
    rng = random.Random(whole)
    docs = table(spark, ODD + [made_text(rng) for _ in range(150)])
    got = periodic.periodic_runs(docs, whole=whole).collect()
    by_id = defaultdict(list)
    for r in got:
        by_id[r["doc_id"]].append(r)
    rows = docs.collect()
    assert len(got) == len(rows)
    for row in rows:
        r = by_id[row["doc_id"]].pop()
        words = re.findall(r"[^\x20\x09-\x0D]+", row["text"] or "")
        runs = plain_runs(words)
        assert [tuple(x) for x in r["runs"]] == runs and r["n_words"] == len(words)
        drop = {i for s, length, q in runs for i in range(s + q, s + length)}
        left = " ".join(w for i, w in enumerate(words) if i not in drop)
        assert r["collapsed_sha256"] == hashlib.sha256(left.encode()).hexdigest()
        assert r["collapsed"] == (left if runs else None)
        top = min(runs, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]), default=None)
        assert (tuple(r["top"]) if r["top"] else None) == top
    assert periodic.periodic_runs(docs.limit(0)).count() == 0


def test_periodic_query(spark, tmp_path):
    rng = random.Random(8)
    texts = ODD + [" ".join(rng.choices("abcdefghijklmnopq", k=rng.randint(1, 400))) for _ in range(150)]
    docs = table(spark, texts)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    want, changed = [], 0
    for row in docs.collect():
        words = re.findall(r"[^\x20\x09-\x0D]+", row["text"] or "")
        n = len(words)
        h = zlib.crc32(str(row["doc_id"]).encode())
        if row["doc_id"] is not None and h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
            changed += 1
        runs = plain_runs(words)
        top = min(runs, key=lambda x: (-Fraction(x[1], x[2]), x[0], x[2]), default=(None,) * 3)
        drop = {i for s, length, q in runs for i in range(s + q, s + length)}
        left = " ".join(w for i, w in enumerate(words) if i not in drop)
        want.append((row["doc_id"], len(runs), *top, 1000 * top[1] // top[2] if runs else None,
                     hashlib.sha256("".join("%d,%d,%d\n" % r for r in runs).encode()).hexdigest(),
                     hashlib.sha256(left.encode()).hexdigest()))
    assert changed > 3
    got = [tuple(r) for r in queries.op13_periodic_runs(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_z_function():
    rng = random.Random(1)
    for _ in range(200):
        s = rng.choices("ab", k=rng.randint(0, 20))
        want = [next((k for k in range(len(s) - i) if s[k] != s[i + k]), len(s) - i) for i in range(len(s))]
        assert periodic.z_function(s) == want
