"""Substitutes, strategies, address arithmetic, mapping store."""

import ipaddress
import uuid

import pytest
from pyspark.sql import functions as F

from veilspark.functions.ip import is_private
from veilspark.functions.keys import mapping_key
from veilspark.functions.patterns import ENTITY_TYPES
from veilspark.functions.pools import LOCALES
from veilspark.functions.strategies import STRATEGIES, apply_strategy
from veilspark.functions.substitutes import substitute
from veilspark.operators import mapping
from veilspark.operators.cleaning import CleanConfig, clean_texts, detect
from veilspark.operators.compare import leaks
from veilspark.operators.skew import keyed_join
from veilspark.plans.with_store import clean_with_store
from veilspark.sources.files import timespan
from veilspark.sources.store import MappingStore
from veilspark.streaming.incremental import clean_batch

TEXTS = [(i, f"mail u{i % 7}@example.com from 10.0.{i % 5}.1 or 8.8.{i % 3}.0/24")
         for i in range(60)]


def texts(spark, parts=3):
    rows = spark.createDataFrame(TEXTS, "id bigint, text string")
    return rows.withColumn("sent", F.expr(
        "cast('2024-01-01' as timestamp_ntz) + make_dt_interval(cast(id as int))")).repartition(
        parts)


def made(spark, name, value, **params):
    rows = spark.createDataFrame([(value,)], "v string")
    return rows.select(apply_strategy(name, F.col("v"), F.lit("CREDIT_CARD"), params)).first()[0]


def test_mask(spark):
    card = "4111-1111-1111-1111"
    assert made(spark, "mask", card) == "*" * 15 + "1111"
    assert made(spark, "mask", card, chars_to_mask=0) == card
    assert made(spark, "mask", card, chars_to_mask=99) == "*" * 19
    assert made(spark, "mask", card, chars_to_mask=4, from_end=True) == "4111-1111-1111-****"
    assert made(spark, "mask", "abc") == "abc"


def test_redact_and_hash(spark):
    assert made(spark, "redact", "x") == "[REDACTED]"
    assert made(spark, "redact", "x", include_type=True) == "[CREDIT_CARD_REDACTED]"
    assert len(made(spark, "hash", "x", hash_type="sha512")) == 128
    assert len(made(spark, "hash", "x", truncate=10)) == 10


@pytest.mark.parametrize("name, params", [
    ("mask", {"chars_to_mask": -1}), ("mask", {"masking_char": "**"}),
    ("hash", {"hash_type": "crc"}), ("hash", {"truncate": 0}), ("redact", {"placeholder": 1}),
    ("replace", {"locale": "xx_XX"}),
])
def test_parameters_are_checked(name, params):
    with pytest.raises(ValueError):
        STRATEGIES[name].validate(params)


def test_substitutes_keep_class_and_prefix(spark):
    ips = ["10.1.2.3", "192.168.1.0/24", "172.16.0.0/12", "10.0.0.0/8", "8.8.8.8/32", "1.2.3.4",
           "203.0.113.0/24", "127.0.0.1", "169.254.3.4/16", "172.31.255.0/30", "64.0.0.0/2"]
    rows = spark.createDataFrame([(i,) for i in ips], "ip string")
    kind = F.lit("IP_ADDRESS")
    out = rows.select("ip", substitute(F.col("ip"), kind, mapping_key(F.col("ip"), kind))
                      .alias("s")).collect()
    ranges = [ipaddress.ip_network(n) for n in (
        "10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "127.0.0.0/8", "169.254.0.0/16")]
    private = lambda x: any(ipaddress.ip_address(x) in n for n in ranges)
    for ip, s in out:
        assert private(ip.split("/")[0]) == private(s.split("/")[0]), (ip, s)
        assert ip.partition("/")[2] == s.partition("/")[2]
        if "/" in ip and int(ipaddress.ip_address(ip.split("/")[0])) % 2 ** (
                32 - int(ip.split("/")[1])) == 0:
            ipaddress.ip_network(s, strict=True)
    assert rows.filter(is_private(F.lit("010.1.2.3"))).count() == 0


def test_version_six_keeps_class_and_prefix(spark):
    ips = ["2a00:1450:4001::8a", "2001:db8:85a3:1:2:8a2e:370:7334", "fd12:3456::1/64", "fe80::1",
           "2600::/32", "2600:1::/48", "2600:1:2::/64", "2600::/20", "fd00:1::/48", "fc00::/7",
           "fd00:1::/40", "FE80::/64", "2600:1:2:3::/128", "2000::/3"]
    rows = spark.createDataFrame([(i,) for i in ips], "ip string")
    kind = F.lit("IP_ADDRESS")
    local = [ipaddress.ip_network(n) for n in ("fc00::/7", "fe80::/10")]
    inside = lambda a: any(ipaddress.ip_address(a) in n for n in local)
    for ip, s in rows.select("ip", substitute(F.col("ip"), kind, mapping_key(F.col("ip"), kind))
                             ).collect():
        assert inside(ip.split("/")[0]) == inside(s.split("/")[0]), (ip, s)
        assert ip.partition("/")[2] == s.partition("/")[2]
        assert (ip != s) or ip in ("fc00::/7", "2000::/3")  # the only ones of their class
        if "::/" in ip:
            ipaddress.ip_network(s, strict=True)


def test_dictionary_spans_in_a_batch(spark, tmp_path):
    terms = spark.createDataFrame([("Ada Lovelace", "PERSON", 0.9)],
                                  "term string, entity_type string, score double")
    rows = spark.createDataFrame(
        [(None, "Ada Lovelace wrote"), (1, "ada lovelace, 10.0.0.1"), (1, "nobody"), (2, None)],
        "id bigint, text string").withColumn("sent", F.lit("2024-01-01").cast("timestamp_ntz"))
    store = MappingStore(spark, str(tmp_path / "store"))
    out = clean_batch(rows, "a", store, str(tmp_path / "out"), terms=terms)
    texts = [r["anonymized_text"] for r in out.collect()]
    assert len(texts) == 4 and texts.count(None) == 1 and "nobody" in texts
    assert not any("lovelace" in (t or "").lower() or "10.0.0.1" in (t or "") for t in texts)
    assert {r["entity_type"] for r in store.mappings().collect()} == {"PERSON", "IP_ADDRESS"}
    assert set(out.columns) == {"id", "sent", "input_length", "anonymized_text", "substitutions",
                                "entities_detected", "entities_anonymized"}


@pytest.mark.parametrize("locale", sorted(LOCALES))
def test_phones_made_here_are_found(spark, locale):
    rows = spark.createDataFrame([(f"v{i}",) for i in range(40)], "v string")
    kind = F.lit("PHONE_NUMBER")
    made = rows.select(F.concat(F.lit("call "), substitute(
        F.col("v"), kind, mapping_key(F.col("v"), kind), locale)).alias("text"))
    found = detect(made, CleanConfig(["PHONE_NUMBER"])).collect()
    assert [r["text"] for r in found if not r["detections"]] == []


def test_every_type_has_a_substitute_and_a_fixed_one(spark):
    rows = spark.createDataFrame([(t, "some value") for t in [*ENTITY_TYPES, "NEW"]],
                                 "t string, v string")
    key = mapping_key(F.col("v"), F.col("t"))
    out = rows.repartition(5).select("t", substitute(F.col("v"), F.col("t"), key).alias("s"))
    first, again = dict(out.collect()), dict(out.repartition(2).collect())
    assert first == again and all(first.values())
    assert first["NEW"].startswith("<REDACTED_")


def test_same_result_for_any_partitioning(spark):
    a = {r["id"]: r["anonymized_text"] for r in clean_texts(texts(spark, 1)).collect()}
    b = {r["id"]: r["anonymized_text"] for r in clean_texts(texts(spark, 9)).collect()}
    assert a == b
    assert leaks(clean_texts(texts(spark))).first()["leaked"] == 0


def test_configured_strategies_apply(spark):
    config = CleanConfig(strategies={"EMAIL_ADDRESS": ("redact", None)})
    rows = clean_texts(texts(spark), config)
    assert rows.filter("anonymized_text like '%[REDACTED]%'").count() == 60
    uses = mapping.span_uses(rows, "sent", types=config.replaced_types)
    assert [r[0] for r in uses.select("entity_type").distinct().collect()] == ["IP_ADDRESS"]


def test_secret_changes_keys_and_substitutes(spark):
    plain = clean_texts(texts(spark)).first()
    keyed = clean_texts(texts(spark), CleanConfig(secret="s")).filter(
        F.col("id") == plain["id"]).first()
    assert plain["anonymized_text"] != keyed["anonymized_text"]


def test_store_counts_overrides_and_deletes(spark, tmp_path):
    store = MappingStore(spark, str(tmp_path / "store"))
    early, late = texts(spark).filter("id < 30"), texts(spark).filter("id >= 30")
    clean_batch(early, "a", store, str(tmp_path / "out"))
    clean_batch(late, "b", store, str(tmp_path / "out"))
    clean_batch(late, "b", store, str(tmp_path / "out"))  # a retry counts nothing twice
    table = store.mappings().collect()
    assert sum(r["substitution_count"] for r in table) == 180 and len(table) == 15
    expected = {tuple(r) for r in mapping.build(
        mapping.span_uses(clean_texts(texts(spark)), "sent")).collect()}
    assert {tuple(r) for r in table} == expected
    one = next(r for r in table if r["entity_type"] == "EMAIL_ADDRESS")
    changes = spark.createDataFrame([(one["mapping_id"], "desk@example.net")],
                                    "mapping_id bigint, new_substitute string")
    store.override(changes)
    assert store.pinned().count() == 1
    outs = [sorted(map(tuple, clean_with_store(
        texts(spark), store.pinned(), name=uuid.uuid4().hex, literals=n)
        .select("id", "anonymized_text").collect())) for n in (1000, 0)]
    assert outs[0] == outs[1]  # literals and join agree
    assert sum("desk@example.net" in t for _, t in outs[0]) == one["substitution_count"]
    assert store.delete(changes) == 1 and store.mappings().count() == 14
    store.compact()
    assert store.mappings().agg(F.sum("substitution_count")).first()[0] == \
        180 - one["substitution_count"]
    assert store.delete_all() == 14 and store.mappings().count() == 0


def test_keyed_join_with_a_hot_key(spark):
    """A third of the rows share a key: salted and broadcast joins give the same rows."""
    big = spark.range(9000).selectExpr(
        "id", "case when id % 3 = 0 then 'hot' else cast(id % 500 as string) end as k")
    small = spark.range(500).selectExpr("cast(id as string) as k", "id as v").union(
        spark.createDataFrame([("hot", -1)], "k string, v bigint"))
    for how in ("inner", "left"):
        a = sorted(map(tuple, keyed_join(big, small, "k", "id", how).collect()))
        b = sorted(map(tuple, keyed_join(big, small, "k", "id", how, small_rows=10).collect()))
        assert a == b and len(a) == 9000


def test_unique_substitutes(spark):
    rows = spark.createDataFrame([("a", "T", "s", 1), ("b", "T", "s", 2), ("c", "NRP", "s", 3),
                                  ("d", "NRP", "s", 4)],
                                 "original_hash string, entity_type string, substitute string, n int"
                                 ).selectExpr("*", "cast('2024-01-01' as timestamp_ntz) as first_seen")
    out = {r["original_hash"]: r["substitute"] for r in mapping.disambiguate(rows).collect()}
    assert out == {"a": "s", "b": "s 2", "c": "s", "d": "s"}


def test_time_spans():
    assert timespan("30m").total_seconds() == 1800 and timespan("7d").days == 7
    with pytest.raises(ValueError):
        timespan("7w")


def test_branches_by_halving_are_those_of_a_chain(spark):
    from veilspark.functions.arrays import by_name
    from veilspark.functions.patterns import ENTITY_TYPES
    rows = spark.createDataFrame([(t,) for t in (*ENTITY_TYPES, None, "", "OTHER", "ZZ", "É")], "t string")
    for n in (0, 1, 3, 4, 7, len(ENTITY_TYPES)):
        made = by_name(F.col("t"), {t: F.lit(t.lower()) for t in list(ENTITY_TYPES)[:n]}, F.lit("last"))
        for t, out in rows.select("t", made).collect():
            assert out == (t.lower() if t in list(ENTITY_TYPES)[:n] else "last")


def test_a_key_is_worked_out_once_for_a_span(spark):
    from veilspark.operators.cleaning import clean_texts
    plan = clean_texts(spark.createDataFrame([("a@b.example.com",)], "text string"))
    assert plan._jdf.queryExecution().analyzed().toString().count("sha2(cast(concat_ws(") == 1
