"""Substitutes that differ whenever their values do: keyed permutations of each format.

The digits of a value are a number in a mixed radix. A Feistel network over two halves of
it, its rounds keyed by SHA-256, maps the numbers of one format onto each other one to one,
so equal substitutes mean equal values and no table has to be asked. Separators stay where
they are, letters are turned by an amount that follows from the new digits, and check
digits are made anew, so that a valid value becomes a valid one. Radices are chosen to hold
exactly the numbers of a class (area, group and serial of an SSN), so no walk out of the
class and back is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .arrays import let
from .checks import luhn_digit, mod97_ok, mod97_rest
from .ip import PRIVATE_RANGES, address, suffix, to_number

ROUNDS = 8
#: Types whose values are numbers, with or without letters.
NUMBERED = ("CREDIT_CARD", "US_SSN", "US_ITIN", "US_BANK_NUMBER", "US_DRIVER_LICENSE",
            "US_PASSPORT", "MEDICAL_LICENSE", "PHONE_NUMBER", "IBAN_CODE")
#: Digits in a value, at most: two halves of 18 fit a number of 64 bits.
MOST_DIGITS = 36
_POWERS = "array({})".format(", ".join(f"{10 ** i}L" for i in range(19)))
_TAG = "veil"

# Ranges that a permuted address does not enter or leave, as bits: the private ones,
# this network, multicast and reserved; local, multicast and global IPv6.
SPECIAL_V4 = tuple(
    format(low, "032b")[:32 - (high ^ low).bit_length()] for low, high in (
        [tuple(sum(int(x) << s for x, s in zip(q.split("."), (24, 16, 8, 0), strict=True)) for q in pair)
         for pair in PRIVATE_RANGES] + [(0, 2 ** 24 - 1), (224 << 24, (240 << 24) - 1), (240 << 24, 2 ** 32 - 1)]))
SPECIAL_V6 = ("00000000", "001", "1111110", "1111111010", "11111111")


def number(tag: Column, step: Column, x: Column) -> Column:
    """60 bits that follow from the key, the round and the other half."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", tag, step, x), 256), 1, 15), 16, 10).cast("bigint")


def feistel(a: Column, b: Column, ra: Column, rb: Column, tag: Column) -> Column:
    """One to one from pairs (a below ra, b below rb) to such pairs, as ``struct<a,b>``."""
    return F.aggregate(
        F.sequence(F.lit(0), F.lit(ROUNDS - 1)),
        F.struct(a.cast("bigint").alias("a"), b.cast("bigint").alias("b")),
        lambda s, i: F.when(i % 2 == 0, F.struct(
            ((s["a"] + number(tag, i, s["b"]) % ra) % ra).alias("a"), s["b"].alias("b"))
        ).otherwise(F.struct(
            s["a"].alias("a"), ((s["b"] + number(tag, i, s["a"]) % rb) % rb).alias("b"))))


def _tag(secret: str, kind: Column, more: Column) -> Column:
    return F.concat_ws("|", F.lit(_TAG + secret), kind, more)


def digits_permuted(digits: Column, tag: Column) -> Column:
    """As many other digits, one to one among those of this length."""
    def halves(n: Column) -> Column:
        p = F.floor(n / 2).cast("int")
        power = lambda k: F.element_at(F.expr(_POWERS), (k + 1).cast("int"))
        half = F.coalesce(F.substring(digits, F.lit(1), p).try_cast("bigint"), F.lit(0).cast("bigint"))
        made = feistel(half, F.substring(digits, p + 1, n).cast("bigint"), power(p), power(n - p), tag)
        return let(made, lambda m: F.concat(
            F.when(p > 0, F.lpad(m["a"].cast("string"), p, "0")).otherwise(""),
            F.lpad(m["b"].cast("string"), n - p, "0")))

    return let(F.length(digits), halves)


def only_digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def refilled(value: Column, digits: Column) -> Column:
    """The value with its digits replaced, everything else in its place."""
    return F.array_join(F.zip_with(
        F.split(value, "[0-9]", -1), F.split(digits, ""),
        lambda gap, d: F.concat(gap, F.coalesce(d, F.lit("")))), "")


def letters_turned(value: Column, seed: Column) -> Column:
    """Each letter moved in its alphabet by an amount that follows from ``seed``."""
    def turned(h: Column) -> Column:
        def one(c: Column, i: Column) -> Column:
            by = F.conv(F.substring(h, (2 * (i % 32) + 1).cast("int"), F.lit(2)), 16, 10).cast("int")
            start = F.when(c.rlike("^[A-Z]$"), 65).when(c.rlike("^[a-z]$"), 97)
            return F.when(start.isNotNull(), F.char(start + (F.ascii(c) - start + by) % 26)).otherwise(c)

        return F.array_join(F.transform(F.split(value, ""), one), "")

    return F.when(value.rlike("[A-Za-z]"), let(F.sha2(seed, 256), turned)).otherwise(value)


def _plain(value: Column, kind: Column, secret: str) -> Column:
    """Digits permuted, letters turned; the country of an international number stays."""
    def built(v: Column) -> Column:
        return let(only_digits(v["rest"]), lambda digits: let(
            _tag(secret, kind, F.concat_ws("|", v["fixed"], F.length(digits))),
            lambda tag: let(digits_permuted(digits, tag), lambda new: F.concat(
                v["fixed"], letters_turned(refilled(v["rest"], new), F.concat_ws("|", tag, new))))))

    fixed = F.when(kind == "MEDICAL_LICENSE", F.regexp_extract(value, "^[A-Za-z]*", 0)).otherwise(
        F.regexp_extract(value, r"^\+[0-9]{2}", 0))
    return let(fixed, lambda f: let(F.struct(
        f.alias("fixed"), F.substring(value, F.length(f) + 1, F.length(value)).alias("rest")), built))


def _card(value: Column, kind: Column, secret: str) -> Column:
    """All digits but the last are permuted; the last is off the check digit by as much as before."""
    def built(digits: Column) -> Column:
        n = F.length(digits)
        body, last = F.substring(digits, F.lit(1), n - 1), F.substring(digits, n, F.lit(1))
        return let(digits_permuted(body, _tag(secret, kind, n)), lambda new: refilled(value, F.concat(
            new, ((luhn_digit(new).cast("int") + last.cast("int") + 10 - luhn_digit(body).cast("int")) % 10
                  ).cast("string"))))

    return let(only_digits(value), built)


def _area_group_serial(value: Column, kind: Column, secret: str) -> Column:
    """SSN and ITIN: each part stays in its class (in use, or not), which keeps a value valid."""
    def classed(v: Column, *ranges: tuple[int, int]) -> Column:
        out = F.struct(v.alias("low"), F.lit(1).cast("bigint").alias("size"))
        for low, high in ranges:
            out = F.when(v.between(low, high), F.struct(
                F.lit(low).cast("bigint").alias("low"),
                F.lit(high - low + 1).cast("bigint").alias("size"))).otherwise(out)
        return out

    def built(digits: Column) -> Column:
        itin = kind == "US_ITIN"
        area, group, serial = (F.substring(digits, i, n).cast("bigint") for i, n in ((1, 3), (4, 2), (6, 4)))
        # 666 is left out: the numbers above it move down by one
        area = F.when(area.between(667, 899), area - 1).when(area == 666, 899).otherwise(area)
        parts = F.struct(
            area.alias("a"), classed(area, (1, 898), (900, 999)).alias("ac"), group.alias("g"),
            F.when(itin, classed(group, (0, 69), (70, 99))).otherwise(classed(group, (1, 99))).alias("gc"),
            serial.alias("s"),
            F.when(itin, classed(serial, (0, 9999))).otherwise(classed(serial, (1, 9999))).alias("sc"))

        def back(p: Column) -> Column:
            tag = _tag(secret, kind, F.concat_ws("|", p["ac"]["low"], p["gc"]["low"], p["sc"]["low"]))
            made = feistel((p["a"] - p["ac"]["low"]) * p["gc"]["size"] + p["g"] - p["gc"]["low"],
                           p["s"] - p["sc"]["low"], p["ac"]["size"] * p["gc"]["size"], p["sc"]["size"], tag)

            def joined(m: Column) -> Column:
                a = p["ac"]["low"] + F.floor(m["a"] / p["gc"]["size"])
                a = F.when(a == 899, 666).when(a.between(666, 898), a + 1).otherwise(a)
                g = p["gc"]["low"] + m["a"] % p["gc"]["size"]
                return F.format_string("%03d%02d%04d", a, g, p["sc"]["low"] + m["b"])

            return let(made, joined)

        return let(parts, lambda p: refilled(value, back(p)))

    return let(only_digits(value), built)


def _iban(value: Column, kind: Column, secret: str) -> Column:
    """The country stays; the account is permuted and gets its check digits."""
    country, account = F.substring(value, 1, 2), F.substring(value, F.lit(5), F.length(value))

    def built(digits: Column) -> Column:
        tag = _tag(secret, kind, F.concat_ws("|", country, F.length(digits)))
        return let(digits_permuted(digits, tag), lambda new: let(
            F.upper(letters_turned(refilled(account, new), F.concat_ws("|", tag, new))),
            lambda made: F.concat(country, F.lpad(
                (98 - mod97_rest(F.concat(made, country, F.lit("00")))).cast("string"), 2, "0"), made)))

    return let(only_digits(account), built)


def unique_number(value: Column, kind: Column, secret: str = "") -> Column:
    """The substitute of a value of one of the ``NUMBERED`` types; null where it has no such form.

    Values of one type with different substitutes differ, and the other way round.
    """
    n = F.length(only_digits(value))
    fits = n.between(1, MOST_DIGITS)
    parts = kind.isin("US_SSN", "US_ITIN") & (n == 9)
    return (
        F.when((kind == "CREDIT_CARD") & n.between(2, MOST_DIGITS), _card(value, kind, secret))
        .when(parts, _area_group_serial(value, kind, secret))
        .when((kind == "IBAN_CODE") & value.rlike("^[A-Z]{2}[0-9]{2}[0-9A-Z]+$") & mod97_ok(value)
              & (F.length(only_digits(F.substring(value, F.lit(5), F.length(value)))) > 0) & fits,
              _iban(value, kind, secret))
        .when(kind.isin(*[t for t in NUMBERED if t not in ("CREDIT_CARD", "IBAN_CODE")])
              & fits & (F.length(only_digits(F.regexp_replace(value, r"^\+[0-9]{2}", ""))) > 0),
              _plain(value, kind, secret))
    )


def to_bits(ip: Column) -> Column:
    """32 or 128 zeros and ones; null for what is no address."""
    groups = lambda text: F.filter(F.split(text, ":"), lambda g: g != "")
    left, right = groups(F.split_part(ip, F.lit("::"), F.lit(1))), groups(F.split_part(ip, F.lit("::"), F.lit(2)))
    open_ = F.contains(ip, F.lit("::"))
    zeros = 8 - F.size(left) - F.size(right)
    listed = F.when(open_, F.concat(left, F.array_repeat(F.lit("0"), zeros), right)).otherwise(left)
    six = ip.rlike("^[0-9A-Fa-f:]+$") & F.contains(ip, F.lit(":")) & ~ip.rlike(":::|::.*::|[0-9A-Fa-f]{5}") & (
        ip.rlike("^([0-9A-Fa-f]+:){7}[0-9A-Fa-f]+$") | (open_ & (zeros >= 1)))
    return let(to_number(ip), lambda four: F.when(four.isNotNull(), F.lpad(F.bin(four), 32, "0")).when(
        six, F.array_join(F.transform(listed, lambda g: F.lpad(F.conv(g, 16, 2), 16, "0")), "")))


def from_bits(bits: Column) -> Column:
    """An address from its bits; IPv6 in eight groups."""
    def groups(n: int, width: int, radix: int, mark: str) -> Column:
        return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda k: F.lower(
            F.conv(F.substring(bits, k * width + 1, F.lit(width)), 2, radix))), mark)

    return F.when(F.length(bits) == 32, groups(4, 8, 10, ".")).otherwise(groups(8, 16, 16, ":"))


def prefix_preserving(ip: Column, secret: str = "") -> Column:
    """Addresses and networks with n leading bits in common keep exactly n; null for others.

    Each bit is turned over or not by the key and the bits before it. On the way to a
    special range no bit is turned, so addresses neither enter nor leave one. Of a network
    only its own bits are changed.
    """
    def facts(bits: Column) -> Column:
        n = F.length(bits)
        length = F.regexp_extract(F.coalesce(suffix(ip), F.lit("")), r"^/(\d{1,3})$", 1)
        own = F.when(length != "", F.least(length.cast("int"), n)).otherwise(n)
        # bits of a host under a network suffix are changed as those of any host
        network = ~F.contains(F.substring(bits, own + 1, n), F.lit("1"))
        ways = F.when(n == 32, F.expr(_ways(SPECIAL_V4))).otherwise(F.expr(_ways(SPECIAL_V6)))
        return F.struct(
            bits.alias("bits"), n.alias("n"), F.when(network, own).otherwise(n).alias("keep"),
            # bits on the way to a special range come first and stay
            F.size(F.filter(ways, lambda w: F.startswith(bits, w))).alias("first"),
            F.concat_ws("|", F.lit(_TAG + secret), n, F.lit("")).alias("head"))

    def changed(f: Column) -> Column:
        def bit(i: Column) -> Column:
            here = F.substring(f["bits"], i + 1, F.lit(1))
            drawn = F.substring(F.sha2(F.concat(f["head"], F.substring(f["bits"], F.lit(1), i)), 256), 1, 1)
            return F.when(F.contains(F.lit("13579bdf"), drawn), F.translate(here, "01", "10")).otherwise(here)

        turned = F.array_join(F.transform(F.sequence(f["first"], f["keep"] - 1), bit), "")
        new = F.when(f["first"] < f["keep"], F.concat(
            F.substring(f["bits"], F.lit(1), f["first"]), turned,
            F.substring(f["bits"], f["keep"] + 1, f["n"]))).otherwise(f["bits"])
        return F.concat(let(new, from_bits), F.coalesce(suffix(ip), F.lit("")))

    return let(to_bits(address(ip)), lambda bits: F.when(bits.isNotNull(), let(facts(bits), changed)))


def _ways(special: tuple[str, ...]) -> str:
    """Every beginning of a special range, the range itself left out. With one all shorter ones
    are in it, so as many as a number starts with, so many of its bits lead to a range."""
    ways = sorted({s[:i] for s in special for i in range(len(s))})
    return f"array({', '.join(repr(w) for w in ways)})"
