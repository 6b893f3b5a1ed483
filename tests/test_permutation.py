"""Substitutes by permutation: one to one, valid where the value is, prefixes kept."""

import ipaddress
import random
import re

import pytest
from pyspark.sql import functions as F

from veilspark.functions.checks import luhn_ok, mod97_ok
from veilspark.functions.permutation import SPECIAL_V4, SPECIAL_V6, prefix_preserving, unique_number
from veilspark.operators.cleaning import CleanConfig, clean_texts


def mapped(spark, kind, values, secret=""):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    return [r[0] for r in df.select(unique_number(F.col("v"), F.lit(kind), secret)).collect()]


@pytest.mark.parametrize("kind", ["PHONE_NUMBER", "US_BANK_NUMBER", "US_PASSPORT", "CREDIT_CARD"])
def test_all_values_of_a_format_are_permuted(spark, kind):
    for values in ([f"{i:03d}" for i in range(1000)], [f"{i:02d}-x{j}" for i in range(100) for j in range(10)]):
        values = values if kind != "PHONE_NUMBER" else [f"+{v}4" for v in values if v.isdigit()] or values
        out = mapped(spark, kind, values)
        assert len(set(out)) == len(values)
        assert all(re.sub("[0-9]", "0", a) == re.sub("[0-9]", "0", re.sub("[a-z]", "x", b))
                   for a, b in zip(values, out, strict=True))
        assert out != values and mapped(spark, kind, values, "key") != out


def test_letters_turn_one_to_one(spark):
    values = [f"{a}{b}{i}" for a in "ABZ" for b in "abz" for i in range(10)]
    out = mapped(spark, "US_DRIVER_LICENSE", values)
    assert len(set(out)) == len(values) and all(re.fullmatch("[A-Z][a-z][0-9]", x) for x in out)


@pytest.mark.parametrize("kind", ["US_SSN", "US_ITIN"])
def test_parts_stay_in_their_class(spark, kind):
    rng = random.Random(2)
    values = [f"{a:03d}-{g:02d}-{s:04d}" for a in (0, 1, 665, 666, 667, 899, 900, 999) for g in (0, 1, 69, 70, 99)
              for s in (0, 1, 9999)] + [f"{rng.randrange(1000):03d}-{rng.randrange(100):02d}-{rng.randrange(10000):04d}"
                                        for _ in range(2000)]
    values = sorted(set(values))
    out = mapped(spark, kind, values)
    assert len(set(out)) == len(values)

    def used(v):
        a, g, s = (int(x) for x in v.split("-"))
        area = "no" if a in (0, 666) else "high" if a >= 900 else "low"
        return (area, a if area == "no" else "", g >= 70, True) if kind == "US_ITIN" else (
            area, a if area == "no" else "", g > 0, s > 0)

    assert all(used(a) == used(b) for a, b in zip(values, out, strict=True))


def test_check_digits(spark):
    cards = ["4111-1111-1111-1111", "378282246310005", "5555 5555 5555 4444", "4111111111111112"]
    ibans = ["DE89370400440532013000", "GB82WEST12345698765432", "FR1420041010050500013M02606"]
    for kind, values, test, good in (("CREDIT_CARD", cards, luhn_ok, [True] * 3 + [False]),
                                     ("IBAN_CODE", ibans, mod97_ok, [True] * 3)):
        out = mapped(spark, kind, values)
        df = spark.createDataFrame(list(enumerate(out)), "i int, v string")
        assert [r[0] for r in df.orderBy("i").select(test(F.col("v"))).collect()] == good
        assert [len(a) for a in values] == [len(b) for b in out] and not set(values) & set(out)


def test_values_without_the_form(spark):
    for kind, value in (("US_SSN", None), ("US_SSN", ""), ("PHONE_NUMBER", "+12"), ("IBAN_CODE", "DE00x"),
                        ("CREDIT_CARD", "4"), ("US_BANK_NUMBER", "1" * 37), ("PERSON", "123")):
        assert mapped(spark, kind, [value]) == [None]


def common(a, b):
    x = int(a) ^ int(b)
    return a.max_prefixlen - x.bit_length()


def test_addresses_keep_their_neighbourhood(spark):
    rng = random.Random(7)
    four = ["10.0.0.0", "10.0.0.1", "10.255.1.2", "172.16.0.1", "172.31.9.9", "172.32.0.1", "192.168.1.1", "192.169.1.1",
            "127.0.0.1", "169.254.3.4", "0.0.0.0", "255.255.255.255", "224.0.0.1"]
    four += [str(ipaddress.IPv4Address(rng.getrandbits(32))) for _ in range(60)]
    six = ["::", "::1", "fe80::1", "fe80::1:2", "fc00::", "fd12:3456::7", "2001:db8::1", "2001:db8::2", "ff02::1"]
    six += [str(ipaddress.IPv6Address((0x2600 << 112) | rng.getrandbits(rng.choice([20, 64, 112])))) for _ in range(30)]
    for values, special in ((four, SPECIAL_V4), (six, SPECIAL_V6)):
        df = spark.createDataFrame([(v,) for v in values], "v string")
        out = [ipaddress.ip_address(r[0]) for r in df.select(prefix_preserving(F.col("v"))).collect()]
        ips = [ipaddress.ip_address(v) for v in values]
        for i in range(len(ips)):
            for j in range(i):
                assert common(ips[i], ips[j]) == common(out[i], out[j])
            bits = [format(int(x), f"0{x.max_prefixlen}b") for x in (ips[i], out[i])]
            assert [[b.startswith(s) for s in special] for b in bits][0] == [bits[1].startswith(s) for s in special]
        assert sum(a == b for a, b in zip(ips, out, strict=True)) < 5
    nets = spark.createDataFrame([("45.67.1.0/24", "45.67.1.9"), ("2600:1::/32", "2600:1::5"), ("1.2.3.4/33", "1.2.3.4")],
                                 "n string, h string")
    for n, h in nets.select(prefix_preserving(F.col("n")), prefix_preserving(F.col("h"))).collect()[:2]:
        assert ipaddress.ip_address(h) in ipaddress.ip_network(n)
    odd = spark.createDataFrame([(x,) for x in (None, "", "x", "1.2.3", "1:2", ":::", "1::2::3", "300.1.1.1")], "v string")
    assert [r[0] for r in odd.select(prefix_preserving(F.col("v"))).collect()] == [None] * 8


def test_texts_and_secret(spark):
    texts = spark.createDataFrame([(1, "card 4111-1111-1111-1111 from 45.1.2.3, a@b.org")], "id int, text string")
    one = clean_texts(texts, CleanConfig(unique=True)).head()["anonymized_text"]
    two = clean_texts(texts, CleanConfig(unique=True, secret="s")).head()["anonymized_text"]
    assert one != two and re.fullmatch(r"card \d{4}-\d{4}-\d{4}-\d{4} from \d+\.\d+\.\d+\.\d+, user_\w+@example.net", one)


def test_an_address_is_worked_out_once(spark):
    """Every use of the new bits and of the facts about the old ones is of a value, not of the work."""
    plan = spark.range(1).select(F.lit("10.1.2.3/24").alias("v"))
    made = plan.select(prefix_preserving(F.col("v")))._jdf.queryExecution().logical().toString()
    assert made.lower().count("sha2(") == 1


def test_bits_on_the_way_to_a_special_range_stay(spark):
    """Against the rule in Python, on addresses in and next to each range and networks of them."""
    import hashlib

    def expected(ip: str) -> str:
        quad, _, length = ip.partition("/")
        bits = "".join(f"{int(x):08b}" for x in quad.split("."))
        own = min(int(length), 32) if length else 32
        keep = 32 if "1" in bits[own:] else own
        new = ""
        for i, b in enumerate(bits):
            leads = any(len(s) > i and s.startswith(bits[:i]) for s in SPECIAL_V4)
            turn = int(hashlib.sha256(f"veil|32|{bits[:i]}".encode()).hexdigest()[0], 16) % 2
            new += str(1 - int(b)) if i < keep and not leads and turn else b
        return ".".join(str(int(new[i:i + 8], 2)) for i in range(0, 32, 8)) + (f"/{length}" if length else "")

    ips = [f"{a}.{b}.{c}.{d}{s}" for a in (0, 9, 10, 11, 126, 127, 169, 172, 192, 223, 224, 240, 255)
           for b in (15, 16, 168, 254) for c, d, s in ((1, 7, ""), (0, 0, "/16"), (0, 0, "/0"), (9, 9, "/24"), (1, 0, "/33"))]
    df = spark.createDataFrame([(x,) for x in ips], "v string")
    out = {r[0]: r[1] for r in df.select("v", prefix_preserving(F.col("v"))).collect()}
    assert out == {x: expected(x) for x in ips}
