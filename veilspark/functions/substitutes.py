"""Substitutes as a pure function of value, type and key.

A retried task, another partitioning or a later run gives the same answer, so a
substitute never has to be fetched to be known: the mapping table records it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from .arrays import by_name, let
from .checks import luhn_digit
from .ip import substitute_ip
from .keys import draw, padded
from .permutation import NUMBERED, prefix_preserving, unique_number
from .pools import (
    BASE58,
    DEFAULT_LOCALE,
    GROUPS,
    NAME_PARTS,
    PHONE_FORMATS,
    STREET_SUFFIXES,
    STREET_NAMES,
    STREETS,
    WALLET_PREFIXES,
    cities_of,
    language_of,
)

_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def pick(pool: tuple[str, ...], number: Column) -> Column:
    """One of a short constant pool."""
    constant = F.expr("array({})".format(", ".join(f"'{p}'" for p in pool)))
    return constant[(number % len(pool)).cast("int")]


def letter(number: Column) -> Column:
    return F.substring(F.lit(_LETTERS), (number % 26 + 1).cast("int"), F.lit(1))


def _seven(h: Column, k: int) -> Column:
    return padded(draw(h, k) % 10**7, 7)


def person(h: Column, language: str) -> Column:
    first_head, first_tail, last_head, last_tail = NAME_PARTS[language]
    return F.concat(
        pick(first_head, draw(h, 0)), pick(first_tail, draw(h, 1)), F.lit(" "),
        pick(last_head, draw(h, 2)), pick(last_tail, draw(h, 3)),
    )


def place(h: Column, locale: str = DEFAULT_LOCALE) -> Column:
    """A city with its coordinates: ``struct<name, latitude, longitude, country_code>``."""
    cities = cities_of(locale)
    rows = ", ".join(
        f"named_struct('name', '{n}', 'latitude', '{la}', 'longitude', '{lo}', "
        f"'country_code', '{cc}')" for n, la, lo, cc in cities)
    return F.expr(f"array({rows})")[(draw(h, 0) % len(cities)).cast("int")]


def street(h: Column, language: str) -> Column:
    """A street with a number, on the side of it that the language has it on."""
    number = (1 + draw(h, 0) % 9999).cast("string")
    if language not in STREET_NAMES:
        return F.concat_ws(" ", number, pick(STREETS, draw(h, 1)), pick(STREET_SUFFIXES, draw(h, 2)))
    before, names = STREET_NAMES[language]
    name = pick(names, draw(h, 1))
    return F.concat_ws(" ", number, name) if before else F.concat_ws(" ", name, number)


def coordinate(value: Column, h: Column, locale: str = DEFAULT_LOCALE) -> Column:
    far = F.abs(value.try_cast("double")) > 90
    return let(place(h, locale), lambda p: F.when(far, p["longitude"]).otherwise(p["latitude"]))


def card(h: Column) -> Column:
    return let(F.concat(F.lit("4"), _seven(h, 0), _seven(h, 1)),
               lambda body: F.concat(body, luhn_digit(body)))


def iban(h: Column) -> Column:
    """German form: DE, two check digits by mod 97 (D=13, E=14), 18 digits."""
    body = (draw(h, 0) % 10**9) * 10**9 + draw(h, 1) % 10**9
    return let(
        body,
        lambda b: F.concat(F.lit("DE"), padded(98 - ((b % 97) * 10**6 + 131400) % 97, 2),
                           padded(b, 18)),
    )


def wallet(h: Column) -> Column:
    body = F.array_join(
        F.transform(
            F.sequence(F.lit(1), F.lit(32)),
            lambda i: F.substring(
                F.lit(BASE58),
                (F.conv(F.substring(h, 2 * i - 1, F.lit(2)), 16, 10).cast("int") % 58) + 1,
                F.lit(1),
            ),
        ),
        "",
    )
    return F.concat(pick(WALLET_PREFIXES, draw(F.sha2(h, 256), 0)), body)


def guid(h: Column) -> Column:
    return F.concat_ws(
        "-",
        F.substring(h, 1, 8),
        F.substring(h, 9, 4),
        F.concat(F.lit("4"), F.substring(h, 14, 3)),
        F.concat(pick(("8", "9", "a", "b"), draw(h, 2)), F.substring(h, 18, 3)),
        F.substring(h, 21, 12),
    )


def generators(locale: str = DEFAULT_LOCALE) -> dict[str, Callable[[Column, Column], Column]]:
    """For each type a function of (value, key)."""
    language = language_of(locale)
    phone = PHONE_FORMATS[locale]
    return {
        "PERSON": lambda v, h: person(h, language),
        "EMAIL_ADDRESS": lambda v, h: F.concat(F.lit("user_"), F.substring(h, 1, 10),
                                               F.lit("@example.net")),
        "PHONE_NUMBER": lambda v, h: F.format_string(phone, draw(h, 0) % 1000,
                                                     draw(h, 1) % 10000),
        "CREDIT_CARD": lambda v, h: card(h),
        "US_SSN": lambda v, h: F.format_string("%03d-%02d-%04d", 900 + draw(h, 0) % 100,
                                               1 + draw(h, 1) % 99, 1 + draw(h, 2) % 9999),
        "US_BANK_NUMBER": lambda v, h: F.concat(*[letter(draw(h, k)) for k in range(4)],
                                                _seven(h, 4), _seven(h, 5)),
        "US_DRIVER_LICENSE": lambda v, h: F.concat(letter(draw(h, 0)),
                                                   padded(draw(h, 1) % 10**6, 6),
                                                   padded(draw(h, 2) % 10**6, 6)),
        "US_ITIN": lambda v, h: F.format_string("9%02d-%02d-%04d", draw(h, 0) % 100,
                                                70 + draw(h, 1) % 30, 1000 + draw(h, 2) % 9000),
        "US_PASSPORT": lambda v, h: F.concat(letter(draw(h, 0)), padded(draw(h, 1) % 10**8, 8)),
        "IP_ADDRESS": substitute_ip,
        "LOCATION": lambda v, h: place(h, locale)["name"],
        "STREET_ADDRESS": lambda v, h: street(h, language),
        "DATE_TIME": lambda v, h: F.date_format(
            F.date_add(F.lit("1970-01-01").cast("date"), (draw(h, 0) % 20000).cast("int")),
            "yyyy-MM-dd"),
        "NRP": lambda v, h: pick(GROUPS, draw(h, 0)),
        "MEDICAL_LICENSE": lambda v, h: F.concat(F.lit("ML"), padded(draw(h, 0) % 10**8, 8)),
        "URL": lambda v, h: F.concat(F.lit("https://"), F.substring(h, 1, 10),
                                     F.lit(".example.org/")),
        "IBAN_CODE": lambda v, h: iban(h),
        "CRYPTO": lambda v, h: wallet(h),
        "GUID": lambda v, h: guid(h),
        "COORDINATE": lambda v, h: coordinate(v, h, locale),
    }


def default_substitute(h: Column) -> Column:
    return F.concat(F.lit("<REDACTED_"), padded(draw(h, 0) % 10**6, 6), F.lit(">"))


def substitute(
    value: Column,
    entity_type: Column,
    key: Column,
    locale: str = DEFAULT_LOCALE,
    types: list[str] | None = None,
    unique: bool = False,
    secret: str = "",
) -> Column:
    """The substitute of a value. ``types`` keeps only the branches that can occur.

    With ``unique`` numbers of a type, and addresses, get substitutes that differ whenever
    they do (see ``permutation``); values without the form of their type, names, places
    and dates are drawn as usual.
    """
    made = generators(locale)
    if types is not None:
        made = {t: g for t, g in made.items() if t in set(types)}

    def chosen(h: Column) -> Column:
        return by_name(entity_type, {t: make(value, h) for t, make in made.items()},
                       default_substitute(h))

    drawn = let(key, chosen)
    if not unique:
        return drawn
    numbered = [t for t in NUMBERED if types is None or t in types]
    out = drawn
    if numbered:
        out = F.coalesce(F.when(entity_type.isin(*numbered),
                                unique_number(value, entity_type, secret)), out)
    if types is None or "IP_ADDRESS" in types:
        out = F.coalesce(F.when(entity_type == "IP_ADDRESS", prefix_preserving(value, secret)), out)
    return out
