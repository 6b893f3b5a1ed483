"""Check-digit tests as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_ALPHABET = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def luhn_ok(value: Column) -> Column:
    return F.call_function("luhn_check", F.regexp_replace(value, "[^0-9]", ""))


def luhn_digit(digits: Column) -> Column:
    """The digit that makes ``digits`` plus itself pass the Luhn test."""
    return F.element_at(
        F.filter(
            F.transform(F.sequence(F.lit(0), F.lit(9)), lambda d: d.cast("string")),
            lambda d: F.call_function("luhn_check", F.concat(digits, d)),
        ),
        1,
    )


def mod97_rest(text: Column) -> Column:
    """Rest by 97 of a text of digits and letters (10 to 35)."""
    return F.aggregate(
        F.split(F.upper(text), ""),
        F.lit(0),
        lambda acc, c: F.when(
            F.instr(F.lit(_ALPHABET), c) <= 10, acc * 10 + F.instr(F.lit(_ALPHABET), c) - 1
        ).otherwise(acc * 100 + F.instr(F.lit(_ALPHABET), c) - 1) % 97,
    )


def mod97_ok(value: Column) -> Column:
    """IBAN test: first four characters to the end, letters as 10..35, rest 1."""
    return mod97_rest(F.concat(F.substring(value, 5, 40), F.substring(value, 1, 4))) == 1
