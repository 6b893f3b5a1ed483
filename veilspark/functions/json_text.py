"""JSON objects held as text: reading members of any kind and writing changed ones back.

Nothing has to be known about the other members. They keep their order, nested objects and
arrays, nulls, and the digits of their numbers; only white space between them goes.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, functions as F

from .arrays import let

def quoted(text: Column) -> Column:
    """A text as a JSON string."""
    return F.when(text.isNotNull(), let(
        F.to_json(F.struct(text.alias("v"))),
        lambda j: F.substring(j, F.lit(6), F.length(j) - 6)))


def members(text: Column, digits: Column | None = None) -> Column:
    """The members of a JSON object in order; null for anything else.

    ``json`` is the value as JSON, ``text`` the value of a string and null for other
    kinds. Of members with one key the last counts. ``digits`` is for an object that is
    itself a member: the same object in any order with its numbers as first written.
    """
    one = F.json_array_length(F.concat(F.lit("["), text, F.lit("]"))) == 1
    read = F.struct(
        F.from_json(text, "map<string,string>").alias("plain"),
        F.from_json(text if digits is None else digits, "map<string,variant>").alias("typed"))

    def built(both: Column) -> Column:
        keys = F.map_keys(both["plain"])
        # a nested object that repeats a key cannot be typed: its value tells
        told = F.transform(F.map_values(both["plain"]), F.try_parse_json)
        typed = F.map_values(both["typed"]) if digits is None else F.when(
            both["typed"].isNotNull(), F.transform(keys, lambda k: F.try_element_at(both["typed"], k)))
        listed = F.zip_with(F.map_entries(both["plain"]), F.coalesce(typed, told), _member)
        return F.when(F.size(F.array_distinct(keys)) == F.size(keys), listed).otherwise(
            F.filter(listed, lambda m, i: ~F.array_contains(
                F.slice(keys, i + 2, F.size(keys)), m["key"])))

    return F.when(one, let(read, lambda both: F.when(both["plain"].isNotNull(), built(both))))


def _member(entry: Column, value: Column) -> Column:
    plain = entry["value"]

    def chosen(j: Column) -> Column:
        first = F.left(j, F.lit(1))
        whole = F.coalesce(first.isin("{", "["), F.lit(False))
        # digits of large numbers are in the plain text, those of small ones in the variant
        nested = F.left(plain, F.lit(1)).isin("{", "[") & (
            F.json_array_length(F.concat(F.lit("["), plain, F.lit("]"))) == 1)
        exact = whole | (j.rlike("[eE]") & ~plain.rlike("[eE]"))
        return F.struct(
            entry["key"].alias("key"),
            F.when(plain.isNull(), "null").when(first == '"', j).when(j.isNull() & ~nested, quoted(plain))
            .when(j.isNull() | exact, plain).otherwise(j).alias("json"),
            F.when((first == '"') | (j.isNull() & ~nested), plain).alias("text"),
            j.alias("digits"))

    return let(F.to_json(value), chosen)


def member(found: Column, key: str) -> Column:
    """One of :func:`members` by key, null if it is not there."""
    return F.get(F.filter(found, lambda m: m["key"] == key), F.lit(0))


def scalar(found: Column) -> Column:
    """The text of a string, the digits of a number; null for nulls, objects and arrays."""
    other = F.when(~F.left(found["json"], F.lit(1)).isin("{", "[") & (found["json"] != "null"),
                   found["json"])
    return F.coalesce(found["text"], other)


def written(found: Column, changes: Mapping[str, Column]) -> Column:
    """The object with new JSON for the keys of ``changes``; a null change leaves a value."""

    def value(m: Column) -> Column:
        out = F
        for key, json in changes.items():
            out = out.when((m["key"] == key) & json.isNotNull(), json)
        return out.otherwise(m["json"]) if changes else m["json"]

    listed = F.transform(found, lambda m: F.concat(quoted(m["key"]), F.lit(":"), value(m)))
    return F.concat(F.lit("{"), F.array_join(listed, ","), F.lit("}"))


def number_or_text(text: Column) -> Column:
    """JSON of a number when the text is one, else of a string."""
    return F.when(text.rlike(r"^-?(?:0|[1-9]\d*)(?:\.\d+)?$"), text).otherwise(quoted(text))
