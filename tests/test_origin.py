"""Origin by letters: held-out accuracy, a plain second reckoning, odd names."""

import math
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from veilspark.functions.pools import NAME_PARTS
from veilspark.operators.cleaning import CleanConfig, clean_texts
from veilspark.operators.origin import BUCKETS, SCALE, SMOOTHING, OriginModel, _bucket, latin


def parts():
    """Every first and last name that the pools make, with its language as country."""
    out = set()
    for language, (a, b, c, d) in NAME_PARTS.items():
        out |= {(x + y, "first", language) for x in a for y in b}
        out |= {(x + y, "last", language) for x in c for y in d}
    return sorted(out)


def dictionary(spark, rows):
    return spark.createDataFrame([(*r, 1) for r in rows], "part string, kind string, country string, score long")


def test_held_out_accuracy(spark):
    held = [p for p in parts() if zlib.crc32(p[0].encode()) % 5 == 0]
    known = [p for p in parts() if zlib.crc32(p[0].encode()) % 5]
    model = OriginModel(dictionary(spark, known))
    got = spark.createDataFrame(held, "part string, kind string, language string").select(
        "part", "language", model.country(F.col("part")).alias("c")).collect()
    right = sum(r["c"] == r["language"] for r in got) / len(got)
    assert len(held) > 200 and right > 0.85  # chance is 1 in 18

    counts, seen = defaultdict(Counter), set()
    for part, _, country in known:
        if (part.lower(), country) not in seen:
            seen.add((part.lower(), country))
            w = f"^{part.lower()}$"
            counts[country].update(_bucket(w[i:i + 3]) for i in range(len(part)))
    log = lambda n, t: math.floor(SCALE * math.log((n + SMOOTHING) / (t + SMOOTHING * BUCKETS)) + .5)
    for r in got:
        w = f"^{r['part'].lower()}$"
        runs = [_bucket(w[i:i + 3]) for i in range(len(r["part"]))] if len(r["part"]) >= 2 else []
        best = max(sorted(counts), key=lambda c: sum(log(counts[c][b], sum(counts[c].values())) for b in runs)) if runs else None
        assert r["c"] == best


def test_odd_names_and_empty_dictionaries(spark):
    model = OriginModel(dictionary(spark, parts()))
    names = spark.createDataFrame([(x,) for x in (None, "", " ", "a", "Jean", "\t Jean  Luc\n", "1" * 500)], "n string")
    got = [r[0] for r in names.select(model.country(F.col("n"))).collect()]
    assert got[:4] == [None] * 4 and got[4] == got[5] == "fr" and got[6] is not None
    none = OriginModel(dictionary(spark, parts()).limit(0))
    assert {r[0] for r in names.select(none.country(F.col("n"))).collect()} == {None}


def test_names_in_texts_keep_origin_and_script(spark):
    config = CleanConfig(entity_types=["PERSON"], origin=OriginModel(dictionary(spark, parts())))
    rows = [(1, "Иван Петров came", [("PERSON", 0, 11, 0.9)]), (2, "Heinrich Steinmann", [("PERSON", 0, 18, 0.9)]),
            (3, "none", []), (4, None, None)]
    texts = spark.createDataFrame(
        rows, "id int, text string, given array<struct<entity_type:string,start:int,end:int,score:double>>")
    got = {r["id"]: r["anonymized_text"] for r in clean_texts(texts, config, extra="given").collect()}
    firsts, lasts = ({c: {p for p, k, x in parts() if x == c and k == kind} for c in NAME_PARTS} for kind in ("first", "last"))
    one = got[1].removesuffix(" came").split(" ")
    assert one[0] in firsts["ru"] and one[1] in lasts["ru"] and not latin(one[0])
    two = got[2].split(" ")
    assert two[0] in firsts["de"] and two[1] in lasts["de"]
    assert got[3] == "none" and got[4] is None
