"""IPv4 arithmetic on text columns, and substitutes for addresses of both versions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .arrays import let
from .keys import draw

# --- fixed values -----------------------------------------------------------
# Ranges that count as private: RFC 1918, loopback, link-local.
PRIVATE_RANGES = (
    ("10.0.0.0", "10.255.255.255"),
    ("172.16.0.0", "172.31.255.255"),
    ("192.168.0.0", "192.168.255.255"),
    ("127.0.0.0", "127.255.255.255"),
    ("169.254.0.0", "169.254.255.255"),
)
# --- end of fixed values ----------------------------------------------------

# First octets that hold a special-purpose range, and some whose block is public.
SPECIAL_OCTETS = (0, 10, 100, 127, 169, 172, 192, 198, 203)
PUBLIC_OCTETS = tuple(o for o in range(11, 224, 8) if o not in SPECIAL_OCTETS)
# IPv6 addresses of one site or link.
PRIVATE_V6 = "(?i)^f(?:[cd]|e[89ab])"

_QUAD = r"^(?:(?:0|[1-9]\d?|1\d\d|2[0-4]\d|25[0-5])\.){3}(?:0|[1-9]\d?|1\d\d|2[0-4]\d|25[0-5])$"


def _number(quad: str) -> int:
    total = 0
    for part in quad.split("."):
        total = total * 256 + int(part)
    return total


def address(ip: Column) -> Column:
    """The part before a suffix."""
    return F.split_part(ip, F.lit("/"), F.lit(1))


def suffix(ip: Column) -> Column:
    """The suffix with its slash, or null."""
    at = F.instr(ip, "/")
    return F.when(at > 0, F.substring(ip, at, F.length(ip)))


def to_number(quad: Column) -> Column:
    """A dotted quad as a number; null for anything else, leading zeros included."""
    return F.when(
        quad.rlike(_QUAD),
        F.aggregate(F.split(quad, r"\."), F.lit(0).cast("bigint"),
                    lambda acc, part: acc * 256 + part.cast("bigint")),
    )


def to_quad(number: Column) -> Column:
    octets = [F.floor(number / 256**e) % 256 for e in (3, 2, 1, 0)]
    return F.concat_ws(".", *[o.cast("bigint").cast("string") for o in octets])


def is_private(quad: Column) -> Column:
    def within(n: Column) -> Column:
        test = F.lit(False)
        for low, high in PRIVATE_RANGES:
            test = test | n.between(_number(low), _number(high))
        return F.coalesce(test, F.lit(False))

    return let(to_number(quad), within)


def prefix_length(ip: Column) -> Column:
    """The number after the slash when it is one from 0 to 32, else null."""
    text = F.regexp_extract(ip, r"^[^/]*/(\d{1,2})$", 1)
    n = F.when(text != "", text.cast("int"))
    return F.when(n <= 32, n)


def host_block(prefix: Column) -> Column:
    """How many addresses a network of this prefix holds."""
    return F.pow(F.lit(2.0), F.lit(32) - prefix).cast("bigint")


def is_network(ip: Column) -> Column:
    """A suffix is there and all host bits are zero."""
    return F.coalesce(to_number(address(ip)) % host_block(prefix_length(ip)) == 0, F.lit(False))


def _octet(key: Column) -> Column:
    octets = F.expr(f"array({', '.join(str(o) for o in PUBLIC_OCTETS)})")
    return octets[(draw(key, 0) % len(PUBLIC_OCTETS)).cast("int")].cast("bigint")


def _dotted(*parts: Column) -> Column:
    return F.concat_ws(".", *[p.cast("string") for p in parts])


def _host(key: Column, private: Column) -> Column:
    a, b, c = draw(key, 1) % 256, draw(key, 2) % 256, 1 + draw(key, 3) % 254
    return let(
        draw(key, 0) % 3,
        lambda kind: F.when(~private, _dotted(_octet(key), a, b, c))
        .when(kind == 0, _dotted(F.lit("10"), a, b, c))
        .when(kind == 1, _dotted(F.lit("172"), 16 + a % 16, b, c))
        .otherwise(_dotted(F.lit("192.168"), b, c)),
    )


def _network(key: Column, private: Column, prefix: Column) -> Column:
    # Only ranges that can hold a network of this size are drawn from.
    kind = draw(key, 0) % F.when(prefix < 12, 1).when(prefix < 16, 2).otherwise(3)
    a, low = draw(key, 1) % 256, (draw(key, 2) % 256) * 256 + draw(key, 3) % 256
    base = let(kind, lambda k: (
        F.when(~private, _octet(key) * 16777216 + a * 65536)
        .when(k == 0, F.lit(_number("10.0.0.0")) + a * 65536)
        .when(k == 1, F.lit(_number("172.16.0.0")) + (a % 16) * 65536)
        .otherwise(F.lit(_number("192.168.0.0")).cast("bigint"))
    ) + low)
    return let(base, lambda n: F.concat(to_quad(n - n % host_block(prefix)), F.lit("/"),
                                        prefix.cast("string")))


def _substitute_v6(ip: Column, key: Column) -> Column:
    """Of a site (fd...) or in the range kept for documentation (2001:db8), never anyone's.

    A network, written with its zeros left out before the slash, stays one of its size.
    """
    def group(n: int) -> Column:
        return F.substring(key, 1 + 4 * n, 4)

    local = ip.rlike(PRIVATE_V6)
    prefix = F.regexp_extract(ip, r"::/(\d{1,3})$", 1)
    length = F.when(prefix != "", prefix.cast("int"))
    head = F.when(local, F.concat(F.lit("fd"), F.substring(key, 1, 2), F.lit(":"), group(1))
                  ).otherwise(F.concat(F.lit("2001:db8:"), group(0)))
    short = (F.when(local & (length >= 8), "fd00").when(local, "fc00")
             .when(length >= 32, "2001:db8").when(length >= 16, "2001").otherwise("2000"))
    network = F.concat(
        F.when(length >= 64, F.concat(head, F.lit(":"), group(2)))
        .when(length >= 48, head).otherwise(short), F.lit("::/"), prefix)
    host = F.concat(F.concat_ws(":", head, *[group(n) for n in range(2, 7)]),
                    F.when(local, F.concat(F.lit(":"), group(7))).otherwise(F.lit("")),
                    F.coalesce(suffix(ip), F.lit("")))
    return F.when(prefix != "", network).otherwise(host)


def substitute_ip(ip: Column, key: Column) -> Column:
    """Same version, class (private or public), kind (host or network) and suffix."""
    return F.when(F.contains(ip, F.lit(":")), _substitute_v6(ip, key)).otherwise(
        _substitute_v4(ip, key))


def _substitute_v4(ip: Column, key: Column) -> Column:
    found = F.regexp_extract(address(ip), r"(\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3})", 1)
    facts = let(found, lambda quad: F.struct(
        quad.alias("quad"), is_private(quad).alias("private"), is_network(ip).alias("network"),
        prefix_length(ip).alias("prefix")))
    return let(facts, lambda f: F.when(f["network"], _network(key, f["private"], f["prefix"]))
               .when(f["quad"] == "", _host(key, F.lit(False)))
               .otherwise(F.concat(_host(key, f["private"]),
                                   F.coalesce(suffix(ip), F.lit("")))))
