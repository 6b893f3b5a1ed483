"""Queries on substitutes that differ whenever their values do, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.permutation import NUMBERED, ROUNDS, SPECIAL_V4, prefix_preserving
from ..functions.patterns import DEFAULT_THRESHOLD, select_patterns
from ..operators import mapping
from ..operators.cleaning import CleanConfig, clean_texts, output_offsets
from ..operators.skew import keyed_join
from ..session import materialize
from ..sources.derived import IPS, MESSAGES
from . import oracle as o
from .registry import query

CONFIG = CleanConfig(unique=True)


def _number(tag: str, step: str, x: str) -> str:
    return f"('0x' || substr(sha256({tag} || '|' || ({step})::varchar || '|' || ({x})::varchar), 1, 15))::bigint"


def _feistel(a: str, b: str, ra: str, rb: str, tag: str) -> str:
    """The rounds folded over a list of their numbers."""
    return (f"list_reduce(list_transform(range(0, {ROUNDS}), lambda i: [i, 0]::hugeint[]), lambda p, x: "
            f"case when x[1] % 2 = 0 then [(p[1] + {_number(tag, 'x[1]', 'p[2]')} % ({ra})) % ({ra}), p[2]] "
            f"else [p[1], (p[2] + {_number(tag, 'x[1]', 'p[1]')} % ({rb})) % ({rb})] end, "
            f"[({a})::hugeint, ({b})::hugeint])")


def _permuted(d: str, tag: str) -> str:
    p = f"(length({d}) // 2)"
    rest = f"(length({d}) - {p})"
    m = _feistel(f"coalesce(try_cast(left({d}, {p}) as bigint), 0)", f"substr({d}, {p} + 1)::bigint",
                 f"power(10, {p})::hugeint", f"power(10, {rest})::hugeint", tag)
    return (f"list_transform([{m}], lambda m: case when {p} > 0 then lpad(m[1]::varchar, {p}::int, '0') else '' end "
            f"|| lpad(m[2]::varchar, {rest}::int, '0'))[1]")


def _refilled(v: str, d: str) -> str:
    return (f"list_transform([{d}], lambda d: array_to_string(list_transform(range(1, len(regexp_split_to_array({v}, '[0-9]')) + 1), "
            f"lambda i: regexp_split_to_array({v}, '[0-9]')[i] || substr(d, i, 1)), ''))[1]")


def _letters(v: str, seed: str) -> str:
    by = f"('0x' || substr(sha256({seed}), 2 * ((i - 1) % 32) + 1, 2))::int"
    c = f"substr({v}, i, 1)"
    turn = lambda a: f"chr(({a} + (ascii({c}) - {a} + {by}) % 26)::int)"
    return (f"array_to_string(list_transform(range(1, length({v}) + 1), lambda i: case when regexp_matches({c}, '[A-Z]') "
            f"then {turn(65)} when regexp_matches({c}, '[a-z]') then {turn(97)} else {c} end), '')")


def _digits(v: str) -> str:
    return f"regexp_replace({v}, '[^0-9]', '', 'g')"


def unique_number(v: str, kind: str) -> str:
    """For values as the patterns find them."""
    d = _digits(v)
    tag = lambda more: f"('veil|' || {kind} || '|' || {more})"
    body = f"left({d}, length({d}) - 1)"
    check = lambda x: o.luhn_digit(x) + "::int"
    card = _refilled(v, f"list_transform([{_permuted(body, tag(f'length({d})::varchar'))}], lambda w: w || "
                        f"(({check('w')} + right({d}, 1)::int + 10 - {check(f'({body})')}) % 10)::varchar)[1]")
    area = f"(case when left({d}, 3)::int > 666 then left({d}, 3)::int - 1 else left({d}, 3)::int end)"
    group, serial = f"substr({d}, 4, 2)::int", f"right({d}, 4)::int"

    def parts(lows: tuple[int, int, int], sizes: tuple[int, int, int]) -> str:
        low = "|".join(map(str, lows))
        m = _feistel(f"({area} - {lows[0]}) * {sizes[1]} + {group} - {lows[1]}", f"{serial} - {lows[2]}",
                     str(sizes[0] * sizes[1]), str(sizes[2]), tag(o.q(low)))
        a = f"({lows[0]} + m[1] // {sizes[1]})"
        return _refilled(v, f"list_transform([{m}], lambda m: lpad((case when {a} between 666 and 898 then {a} + 1 else {a} end)::varchar, 3, '0') "
                            f"|| lpad(({lows[1]} + m[1] % {sizes[1]})::varchar, 2, '0') || lpad(({lows[2]} + m[2])::varchar, 4, '0'))[1]")

    def plain(fixed: str) -> str:
        rest = f"substr({v}, length({fixed}) + 1)"
        t = tag(f"{fixed} || '|' || length({_digits(rest)})::varchar")
        new = _permuted(_digits(rest), t)
        filled = f"list_transform([{new}], lambda w: [w, {_refilled(rest, 'w')}])[1]"
        return f"{fixed} || list_transform([{filled}], lambda f: {_letters('f[2]', f'{t} || {o.q(chr(124))} || f[1]')})[1]"

    account, country = f"substr({v}, 5)", f"left({v}, 2)"
    t = tag(f"{country} || '|' || length({_digits(account)})::varchar")
    filled = f"list_transform([{_permuted(_digits(account), t)}], lambda w: [w, {_refilled(account, 'w')}])[1]"
    made = f"list_transform([{filled}], lambda f: upper({_letters('f[2]', f'{t} || {o.q(chr(124))} || f[1]')}))[1]"
    spelled = ("array_to_string(list_transform(string_split(b || {c} || '00', ''), lambda c: case when c between 'A' and 'Z' "
               "then (ascii(c) - 55)::varchar else c end), '')").replace("{c}", country)
    rest97 = (f"list_reduce(list_transform(string_split({spelled}, ''), lambda c: c::int), "
              "lambda a, x: (a * 10 + x) % 97, 0)")
    iban = f"list_transform([{made}], lambda b: {country} || lpad((98 - {rest97})::varchar, 2, '0') || b)[1]"
    others = ", ".join(o.q(t) for t in NUMBERED if t not in ("CREDIT_CARD", "IBAN_CODE", "US_SSN", "US_ITIN", "MEDICAL_LICENSE"))
    return (f"(case when {kind} = 'CREDIT_CARD' then {card} when {kind} = 'US_SSN' then {parts((1, 1, 1), (898, 99, 9999))} "
            f"when {kind} = 'IBAN_CODE' then {iban} "
            f"when {kind} in ({others}) then " + plain(f"regexp_extract({v}, '^\\+[0-9]{{2}}')") + " end)")


def prefix_kept(ip: str) -> str:
    """For IPv4."""
    addr = f"split_part({ip}, '/', 1)"
    tail = f"(case when contains({ip}, '/') then substr({ip}, instr({ip}, '/')) else '' end)"
    length = f"try_cast(regexp_extract({ip}, '^[^/]*/([0-9]{{1,3}})$', 1) as int)"
    own = f"least(coalesce({length}, 32), 32)"
    bits = f"lpad(bin({o.number(addr)}), 32, '0')"
    keep = f"(case when contains(substr(b, {own} + 1), '1') then 32 else {own} end)"
    leads = f"len(list_filter({o.lst(SPECIAL_V4)}, lambda s: length(s) > i and starts_with(s, left(b, i)))) > 0"
    turn = "('0x' || left(sha256('veil|32|' || left(b, i)), 1))::int % 2 = 1"
    new = (f"array_to_string(list_transform(range(0, 32), lambda i: case when i < {keep} and not {leads} and {turn} "
           "then translate(substr(b, i + 1, 1), '01', '10') else substr(b, i + 1, 1) end), '')")
    quad = " || '.' || ".join(f"('0b' || substr(w, {8 * k + 1}, 8))::int::varchar" for k in range(4))
    return (f"(case when {o.number(addr)} is not null then list_transform([{bits}], lambda b: "
            f"list_transform([{new}], lambda w: {quad})[1])[1] || {tail} end)")


_KINDS = sorted({p.entity_type for p in select_patterns(None, DEFAULT_THRESHOLD)})
_SUB = f"""hashed as (select *, {o.key('value', 'entity_type')} as h from res),
sub as (select *, coalesce(case when entity_type = 'IP_ADDRESS' then {prefix_kept('value')} else {unique_number('value', 'entity_type')} end,
 {o.substitute('value', 'entity_type', 'h', _KINDS)}) as substitute from hashed)"""
UNIQUE = f"with src as ({MESSAGES.sql}),\n{o.detections('src')},\n{o.resolved('src')},\n{_SUB}"
_NEVER_TWICE = (*NUMBERED, "IP_ADDRESS")


def _uses(spark, folder):
    return mapping.span_uses(clean_texts(MESSAGES.frame(spark, folder), CONFIG), "sent", "id")


@query("anonymize_unique", UNIQUE + f",\n{o.rewritten('src')} select id, anonymized_text from done")
def anonymize_unique(spark, folder):
    return clean_texts(MESSAGES.frame(spark, folder), CONFIG).select("id", "anonymized_text")


@query("unique_mapping", UNIQUE + "select entity_type, h as original_hash, substitute, count(*) as uses from sub group by all")
def unique_mapping(spark, folder):
    return mapping.build(_uses(spark, folder)).select(
        "entity_type", "original_hash", "substitute", F.col("substitution_count").alias("uses"))


@query("unique_collisions", UNIQUE + f"""select entity_type, substitute, count(distinct h) as "values" from sub
 where entity_type in ({', '.join(map(o.q, _NEVER_TWICE))}) group by 1, 2 having count(distinct h) > 1""")
def unique_collisions(spark, folder):
    """No row: numbers and addresses that differ never share a substitute."""
    return mapping.collisions(mapping.build(_uses(spark, folder))).filter(
        F.col("entity_type").isin(*_NEVER_TWICE))


@query("unique_agrees", UNIQUE + "select entity_type, count(*) as uses, count(distinct h) as \"values\", 0::bigint as disagreements from sub group by 1")
def unique_agrees(spark, folder):
    """What stands in the cleaned texts against the mapping, by type."""
    cleaned = materialize(clean_texts(MESSAGES.frame(spark, folder), CONFIG), "cleaned")
    store = mapping.build(mapping.span_uses(cleaned, "sent", "id"))
    placed = F.zip_with("substitutions", output_offsets(F.col("substitutions")), lambda s, at: F.struct(
        s["entity_type"].alias("entity_type"), s["original_hash"].alias("original_hash"),
        F.substring("anonymized_text", at["out_start"] + 1, at["out_end"] - at["out_start"]).alias("stands")))
    written = cleaned.select("id", F.explode_outer(placed).alias("p")).filter("p is not null").select(
        "id", "p.entity_type", "p.original_hash", "p.stands")
    met = keyed_join(written, store.select("original_hash", "substitute"), "original_hash", "id", "left")
    return met.groupBy("entity_type").agg(
        F.count("*").alias("uses"), F.count_distinct("original_hash").alias("values"),
        F.count_if(~F.col("stands").eqNullSafe(F.col("substitute"))).alias("disagreements"))


@query("ip_prefix_preserving", f"with src as ({IPS.sql}) select id, ip, {prefix_kept('ip')} as kept from src")
def ip_prefix_preserving(spark, folder):
    return IPS.frame(spark, folder).select("id", "ip", prefix_preserving(F.col("ip")).alias("kept"))
