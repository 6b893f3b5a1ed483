"""Patterns, context, threshold and overlaps on small texts."""

import random
import re

import pytest
from pyspark.sql import functions as F

from veilspark.functions.arrays import chunks, piece, running_max, running_sum
from veilspark.functions.patterns import PATTERNS, select_patterns
from veilspark.functions.spans import merge_overlaps
from veilspark.operators.cleaning import CleanConfig, clean_texts, clean_value, detect, resolved

SAMPLE = (
    "Call me at 555-123-4567 or (555) 987-6543. SSN: 456-78-9012 born 03/15/1985 at "
    "12 Oak Street, Apt 4B 192.168.1.0/24 j@x.com 4111-1111-1111-1111 \U0001F926 10.0.0.1"
)


def spans(spark, text, resolve=False, **config):
    rows = spark.createDataFrame([(1, text)], "id int, text string")
    made = (resolved if resolve else detect)(rows, CleanConfig(**config))
    return [tuple(s) for s in made.first()["spans" if resolve else "detections"]]


def test_sample_text(spark):
    found = spans(spark, SAMPLE, resolve=True)
    assert [(t, v) for t, *_, v in found] == [
        ("PHONE_NUMBER", "555-123-4567"), ("PHONE_NUMBER", "(555) 987-6543"),
        ("US_SSN", "456-78-9012"), ("DATE_TIME", "03/15/1985"),
        ("STREET_ADDRESS", "12 Oak Street, Apt 4B"), ("IP_ADDRESS", "192.168.1.0/24"),
        ("EMAIL_ADDRESS", "j@x.com"), ("CREDIT_CARD", "4111-1111-1111-1111"),
        ("IP_ADDRESS", "10.0.0.1")]
    assert all(SAMPLE[a:b] == v for _, a, b, _, v in found)


@pytest.mark.parametrize("text, kind, hit", [
    ("ssn 666-12-3456", "US_SSN", False), ("ssn 123-00-4567", "US_SSN", False),
    ("ssn 123-45-6789", "US_SSN", True), ("code 123-45-6789", "US_SSN", False),
    ("on 2024-01-31 x", "DATE_TIME", False), ("born 2024-01-31 x", "DATE_TIME", True),
    ("Stockton-On-Tees", "LOCATION", True), ("stockton-on-tees", "LOCATION", False),
    ("Newcastle upon Tyne", "LOCATION", True), ("51.500789", "COORDINATE", True),
    ("51.5007", "COORDINATE", False), ("4111-1111-1111-1112", "CREDIT_CARD", False),
    ("DE89370400440532013000", "IBAN_CODE", True), ("DE00370400440532013000", "IBAN_CODE", False),
    ("call 5551234567", "PHONE_NUMBER", True), ("ref 5551234567", "PHONE_NUMBER", False),
    ("date of birth: March 4, 1980", "DATE_TIME", True), ("256.1.1.1", "IP_ADDRESS", False),
    ("see https://a.example/x.", "URL", True), ("ssn 123456789", "US_SSN", False),
    ("é192.168.1.1", "IP_ADDRESS", False),
    ("from 2001:0db8:85a3:0000:0000:8a2e:0370:7334.", "IP_ADDRESS", True),
    ("from 2001:DB8::1/64", "IP_ADDRESS", True), ("net fd00:1::/48", "IP_ADDRESS", True),
    ("fe80::1:2 up", "IP_ADDRESS", True), ("std::vector ad::be", "IP_ADDRESS", False),
    ("00:1a:2b:3c:4d:5e at 12:30:45", "IP_ADDRESS", False),
    ("+44 20 7946 0958", "PHONE_NUMBER", True), ("+49 30 1234567", "PHONE_NUMBER", True),
    ("+358 9 1234567", "PHONE_NUMBER", True), ("+1 (555) 987-6543", "PHONE_NUMBER", True),
    ("+4512", "PHONE_NUMBER", False), ("+1.5", "PHONE_NUMBER", False),
])
def test_hits_and_near_misses(spark, text, kind, hit):
    assert bool(spans(spark, text, entity_types=[kind])) is hit


def test_offsets_agree_with_a_plain_scan(spark):
    """Every pattern, on random texts: offsets and values as a plain regex gives them."""
    rng = random.Random(7)
    words = ["555-123-4567", "10.2.3.4", "a@b.org", "1985-02-03", "\U0001F600", "café", "x",
             "12 Elm Street", "Stow-In-The-Wold", "4242424242424242", "\n", "\x01", "1.1234567"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 30))) for _ in range(40)]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    chosen = [p for p in PATTERNS if not p.checksum]
    made = detect(rows, CleanConfig(threshold=0.0), "text", chosen, False).collect()
    for row in made:
        expected = sorted(
            (m.start(), m.end(), p.entity_type) for p in chosen
            for m in re.finditer(p.regex, row["text"], re.I if p.ignore_case else 0))
        got = sorted((s["start"], s["end"], s["entity_type"]) for s in row["detections"])
        assert got == expected
        assert all(row["text"][s["start"]:s["end"]] == s["text"] for s in row["detections"])


def test_running_folds_and_pieces_on_long_input(spark):
    rng = random.Random(1)
    values = [rng.randint(0, 50) for _ in range(1000)]
    text = "".join(rng.choice("ab\U0001F600 \n") for _ in range(5000))
    rows = spark.createDataFrame([(values, text)], "v array<int>, t string")
    cuts = [(0, 0), (0, 1), (1023, 1025), (1024, 2048), (10, 4990), (4999, 5000)]
    made = rows.select(
        running_sum(F.col("v")).alias("s"), running_max(F.col("v")).alias("m"),
        *[piece(chunks(F.col("t")), F.lit(a), F.lit(b)).alias(f"p{i}")
          for i, (a, b) in enumerate(cuts)]).first()
    assert made["s"] == [sum(values[:i]) for i in range(1000)]
    assert made["m"] == [max([0, *values[:i]]) for i in range(1000)]
    assert [made[f"p{i}"] for i in range(len(cuts))] == [text[a:b] for a, b in cuts]


def test_many_hits_in_one_text(spark):
    rows = spark.createDataFrame([(1, "x 10.0.0.1 y " * 3000)], "id int, text string")
    out = clean_texts(rows).first()
    assert out["entities_anonymized"] == 3000
    assert len({s["substitute"] for s in out["substitutions"]}) == 1
    assert out["anonymized_text"] == f"x {out['substitutions'][0]['substitute']} y " * 3000


def test_long_run_of_plain_words(spark):
    text = "1 " + "word " * 40000
    rows = spark.createDataFrame([(1, text)], "id int, text string")
    assert clean_texts(rows).first()["anonymized_text"] == text


def test_no_type_means_all_and_unknown_is_an_error():
    assert select_patterns([]) == select_patterns(None)
    assert all(p.name != "ssn_no_dashes" for p in select_patterns(None, 0.7))
    with pytest.raises(ValueError):
        select_patterns(["NO_SUCH_TYPE"])
    with pytest.raises(ValueError):
        select_patterns(None, 1.5)


def test_case_sensitive_streets(spark):
    rows = spark.createDataFrame([(1, "1 chst and 12 Main Street")], "id int, text string")
    strict = select_patterns(["STREET_ADDRESS"], 0.6, case_sensitive_streets=True)
    made = detect(rows, CleanConfig(threshold=0.6), "text", strict).first()["detections"]
    assert [s["text"] for s in made] == ["12 Main Street"]


def test_expression_form_equals_the_steps(spark):
    rows = spark.createDataFrame([(1, SAMPLE), (2, ""), (3, "nothing"), (4, None)],
                                 "id int, text string")
    steps = {r["id"]: r["anonymized_text"] for r in clean_texts(rows).collect()}
    inline = {r["id"]: r["t"] for r in rows.select("id", clean_value(F.col("text")).alias("t"))
              .collect()}
    assert steps[2] == "" and steps[3] == "nothing"
    assert {k: steps[k] for k in (1, 2, 3)} == {k: inline[k] for k in (1, 2, 3)}
    assert steps[4] is None and inline[4] is None


def test_patterns_run_once_under_a_filter(spark):
    rows = spark.createDataFrame([(1, SAMPLE)], "id int, text string")
    plan = clean_texts(rows).filter("entities_detected > 0 and id = 1")._jdf.queryExecution(
    ).executedPlan().toString()
    assert plan.count("us_phone") == 0 and plan.count(r"\(\d{3}\)\s*\d{3}") <= 5
    assert "Exchange" not in plan and "Python" not in plan


@pytest.mark.parametrize("text, expected", [
    ("ship to 12 Aa Bb Cc Dd Ee Ff Gg Hh Ii Street now", "12 Aa Bb Cc Dd Ee Ff Gg Hh Ii Street"),
    ("ship to 12 Main Street and Second Road now", "12 Main Street and Second Road"),
    ("ship to 12 St Marys Rd. Apt 7", "12 St Marys Rd. Apt 7"),
    ("ship to 12 Oakstreet now", "12 Oakstreet"),
    ("ship to 12 Main a Street now", None),
    ("ship to 12 Main St. Paul", "12 Main St"),
    ("ship to 7 " + "Long " * 2000 + "Street, Unit 4b", "7 " + "Long " * 2000 + "Street, Unit 4b"),
])
def test_streets_of_any_length(spark, text, expected):
    found = spans(spark, text, resolve=True, entity_types=["STREET_ADDRESS"], threshold=0.5)
    assert [s[-1] for s in found] == ([expected] if expected else [])


def test_streets_as_an_open_repeat_finds_them():
    rng = random.Random(3)
    words = ["12", "7", "Main", "a", "St", "Oakst", "Road", "Apt", "Way,", "Dr.", "Unit 4b", "#3"]
    ends = {p.name: p for p in PATTERNS if p.entity_type == "STREET_ADDRESS"}
    from veilspark.plans.oracle import _OPEN
    for _ in range(3000):
        text = " ".join(rng.choice(words) for _ in range(rng.randint(1, 14)))
        for name, p in ends.items():
            mine = [m.span() for m in re.finditer(p.regex, text, re.I)]
            assert mine == [m.span() for m in re.finditer(_OPEN[name], text, re.I)], text


def test_compound_places_of_any_length(spark):
    place = "Quito" + "-On-Ggg" * 9
    assert [s[-1] for s in spans(spark, f"in {place} x", entity_types=["LOCATION"])] == [place]


def test_context_is_five_words_of_any_length(spark):
    for length in (90, 110, 5000):
        text = "ssn " + "z" * length + " 456-78-9012"
        assert [s[-1] for s in spans(spark, text, entity_types=["US_SSN"])] == ["456-78-9012"]
    six = "ssn a b c d e 456-78-9012"
    assert not spans(spark, six, entity_types=["US_SSN"])


def test_terms_of_four_words(spark):
    from veilspark.operators.gazetteer import gazetteer_spans

    texts = spark.createDataFrame([(1, "the Isle Of Great Wight is")], "id int, text string")
    terms = spark.createDataFrame([("isle of great wight", "LOCATION", 0.9)],
                                  "term string, entity_type string, score double")
    assert [r["text"] for r in gazetteer_spans(texts, terms, "id").collect()] == [
        "Isle Of Great Wight"]


def test_pins_keep_every_row_and_only_replace(spark):
    from veilspark.plans.with_store import clean_with_store

    texts = spark.createDataFrame(
        [(None, "a@b.org"), (1, "c@d.org 10.0.0.1"), (1, "a@b.org 10.0.0.1"), (None, "x")],
        "id int, text string")
    config = CleanConfig(strategies={"IP_ADDRESS": ("redact", {})})
    plain = clean_texts(texts, config).selectExpr("inline(substitutions)").distinct()
    pins = plain.selectExpr("original_hash", "entity_type", "'PIN' as substitute")
    one = sorted(r[0] for r in clean_with_store(texts, pins, config, literals=100).select(
        "anonymized_text").collect())
    two = sorted(r[0] for r in clean_with_store(texts, pins, config, literals=0).select(
        "anonymized_text").collect())
    assert one == two == ["PIN", "PIN [REDACTED]", "PIN [REDACTED]", "x"]


def test_spans_that_touch_stay_apart_and_overlaps_merge(spark):
    found = lambda *spans: F.expr("array({})".format(", ".join(
        f"named_struct('start', {a}, 'neg_end', -{b}, 'rank', 1, 'entity_type', '{t}', 'score', 0.8D, "
        f"'text', substr('abcdefghij', {a + 1}, {b - a}))" for t, a, b in spans)))
    def merged(*spans):
        row = spark.range(1).select(merge_overlaps(found(*spans), chunks(F.lit("abcdefghij"))).alias("s"))
        return [(s["entity_type"], s["start"], s["end"], s["text"]) for s in row.first()["s"]]

    assert merged(("A", 0, 2)) == [("A", 0, 2, "ab")]
    assert merged(("A", 0, 2), ("B", 2, 5)) == [("A", 0, 2, "ab"), ("B", 2, 5, "cde")]
    assert merged(("A", 0, 2), ("B", 1, 5), ("C", 5, 7), ("D", 6, 7)) == [
        ("B", 0, 5, "abcde"), ("C", 5, 7, "fg")]


def test_texts_without_overlaps_skip_the_island_step(spark):
    """Most texts: their spans are taken over, pieces of the text are not cut again."""
    one = F.expr("array(named_struct('start', 0, 'neg_end', -2, 'rank', 1, 'entity_type', 'A', "
                 "'score', 0.8D, 'text', 'ab'))")
    row = spark.range(1).select(merge_overlaps(one, F.array(F.lit("zz"))).alias("s")).first()
    assert row["s"][0]["text"] == "ab"


def test_the_shape_of_a_text_hides_no_match(spark):
    from veilspark.functions.spans import find_hits, text_shape

    rng = random.Random(5)
    given = ["12 Elm Street", "7  High\tRd, Apt 4B", "10.2.3.4/24", "123-45-6789", "1/2/2020", "3-4-1999",
             "1999-1-2", "March\n3, 1999", "Newton-On-Tees", "Stow upon\x0bTees", "45.1234567", "(555) 123-4567",
             "555.123 4567", "5551234567", "+49 30 1234567", "a@b.example.com", "4242424242424242",
             "4111-1111 1111-1111", "https://a.example.com/x", "www.a.example.com", "123456788",
             "DE89370400440532013000", "X12345678", "123456789012",
             "A123456789012", "ml7", "Ab1234567", "2001:db8::1:2", "bc1" + "q" * 30,
             "0a1b2c3d-0a1b-0a1b-0a1b-0a1b2c3d4e5f", "901-70-1234", "st", "Dr.", " ", "\f", "-", "x", "é", "\x01"]
    texts = ["".join(rng.choice(given) + rng.choice(["", " ", ", ", "\n"]) for _ in range(rng.randint(1, 6)))
             for _ in range(600)] + given + [""]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string")
    chosen = list(PATTERNS)
    by = lambda shape: F.sort_array(F.filter(
        find_hits(F.col("text"), shape, chosen), lambda h: F.size(h["pieces"]) > 1))
    both = rows.select("text", text_shape(F.col("text")).alias("shape")).select(
        "text", by(F.col("shape")).alias("quick"), by(F.lit(None).cast("string")).alias("slow")).collect()
    assert {p for r in both for p, _ in r["slow"]} == set(range(len(chosen)))
    for r in both:
        assert r["quick"] == r["slow"], r["text"]
        assert all("".join(h["pieces"]) == r["text"] for h in r["quick"])


def test_patterns_are_compiled_and_not_in_a_generator(spark):
    from veilspark.operators.cleaning import with_spans

    texts = spark.createDataFrame([("call 555-123-4567",)], "text string")
    plan = with_spans(texts)._jdf.queryExecution().optimizedPlan().toString()
    generators = [line for line in plan.splitlines() if "Generate" in line]
    assert generators and not any("regexp_replace" in line for line in generators)


def test_single_matches_are_found_as_others_are(spark):
    """The short way for patterns that match once against the way over arrays."""
    from veilspark.functions.patterns import select_patterns
    from veilspark.functions.spans import (
        FOUND, chunks as cut, find_hits, place_spans, score_spans, text_shape)
    from veilspark.operators.cleaning import with_spans

    bodies = ["ssn 123-45-6789", "123-45-6789", "my social  security 123-45-6789 ok",
              "call\t555-123-4567 or 555-123-4568", "a b c d e f born 1990-01-02", "born a b c d e 1990-01-02",
              "id 4111-1111-1111-1111 and 4111-1111-1111-1112", "DE89370400440532013000 DE00370400440532013000",
              "March 3, 1999 issued", "expires March 3, 1999", "valid 1/2/2003", "dob 11-12-1999", "exp 1-2/2003",
              " 12 Oak Street, Apt 4", "Ship to 12 Oak Street", "é born 1990-01-02", "x\x01 born 1990-01-02", "", None]
    texts = spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "id int, text string")
    chosen = select_patterns(None, 0.3)
    rows = texts.withColumn("hits", find_hits(F.col("text"), text_shape(F.col("text")), chosen)).withColumn(
        "placed", place_spans(F.col("hits"), chosen)).withColumn("parts", cut(F.col("text")))
    slow = rows.select("id", F.when(F.size("hits") > 0, score_spans(
        F.col("placed"), F.col("parts"), chosen, 0.3)).otherwise(F.array().cast(f"array<{FOUND}>")).alias("f"))
    fast = with_spans(texts, CleanConfig(threshold=0.3)).select("id", F.col("found").alias("f"))
    told = lambda rows: {r["id"]: r["f"] or [] for r in rows.collect()}
    assert told(fast) == told(slow) and sum(map(len, told(fast).values())) > 15
