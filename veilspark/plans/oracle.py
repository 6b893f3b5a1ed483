"""The same results in plain SQL, for a check in another engine.

Only input formulas and fixed values are shared with the Spark side. Offsets,
context, overlaps and substitutes are worked out here by window functions and
list functions instead of higher-order functions over arrays.
"""

from __future__ import annotations

from ..functions.ip import PRIVATE_RANGES, PUBLIC_OCTETS
from ..functions.patterns import (
    CONTEXT_WORDS,
    DEFAULT_THRESHOLD,
    TYPE_RANK,
    Pattern,
    select_patterns,
)
from ..functions.pools import (
    BASE58,
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

# Written out again with open repeats, which the other engine follows without a stack.
_STREET = r"\b\d{1,5}\s+[A-Z]{2,}(?:\s+[A-Z]{2,})*\s*"
_SHORT = (r"Street|St\.?|Avenue|Ave\.?|Road|Rd\.?|Boulevard|Blvd\.?|Drive|Dr\.?|Lane|Ln\.?"
          r"|Way|Court|Ct\.?|Place|Pl\.?")
_OPEN = {
    "street_address_full": _STREET + rf"(?:{_SHORT}|Circle|Cir\.?|Trail|Trl\.?|Parkway"
    r"|Pkwy\.?|Highway|Hwy\.?)\b",
    "street_address_with_unit": _STREET + rf"(?:{_SHORT})"
    r"\s*,?\s*(?:Apt\.?|Suite|Ste\.?|Unit|#)\s*\d+[A-Z]?\b",
    "compound_location_hyphen": r"\b[A-Z][a-z]+(?:-(?:On|Upon|By|In|Under|Over|Le|La|The|Of|At"
    r"|Near)-[A-Z][a-z]+)+\b",
}

# Patterns with look-ahead, which the other engine lacks: plain digits, then a test.
_PLAIN = {
    "ssn_dashes": (r"\b\d{3}-\d{2}-\d{4}\b", "-"),
    "ssn_no_dashes": (r"\b\d{9}\b", ""),
}


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def lst(items) -> str:
    return "[" + ", ".join(q(str(i)) for i in items) + "]"


def _regex(p: Pattern) -> str:
    body = _PLAIN[p.name][0] if p.name in _PLAIN else _OPEN.get(p.name, p.regex)
    return q(("(?i)" if p.ignore_case else "") + body)


def _test(p: Pattern) -> str:
    if p.name in _PLAIN:
        d = f"replace(v, {q('-')}, '')"
        return (f"substr({d},1,3) not in ('000','666') and substr({d},1,1) <> '9' "
                f"and substr({d},4,2) <> '00' and substr({d},6,4) <> '0000'")
    if p.checksum == "luhn":
        return luhn("regexp_replace(v, '[^0-9]', '', 'g')")
    if p.checksum == "mod97":
        return mod97("v")
    return "true"


def luhn(d: str) -> str:
    """Sum of digits from the right, every second doubled and reduced, divisible by ten."""
    return (
        f"(list_sum(list_transform(range(1, length({d}) + 1), lambda i: "
        f"case when i % 2 = 0 then (substr(reverse({d}), i, 1)::int * 2) % 10 "
        f"+ (substr(reverse({d}), i, 1)::int * 2) // 10 "
        f"else substr(reverse({d}), i, 1)::int end)) % 10 = 0)"
    )


def mod97(v: str) -> str:
    turned = f"upper(substr({v}, 5) || substr({v}, 1, 4))"
    digits = (f"array_to_string(list_transform(string_split({turned}, ''), lambda c: "
              f"case when c between 'A' and 'Z' then (ascii(c) - 55)::varchar else c end), '')")
    return (f"(list_reduce(list_prepend(0, list_transform(string_split({digits}, ''), "
            f"lambda c: c::int)), lambda a, d: (a * 10 + d) % 97) = 1)")


def detections(src: str, types=None, threshold: float = DEFAULT_THRESHOLD,
               patterns: list[Pattern] | None = None, context: bool = True) -> str:
    """CTEs ending in ``det(id, entity_type, rank, start, end_, score, value)``."""
    chosen = select_patterns(types, threshold) if patterns is None else patterns
    parts = []
    for p in chosen:
        r = _regex(p)
        parts.append(
            f"select id, text, {TYPE_RANK[p.entity_type]} as rank, {q(p.entity_type)} as entity_type, "
            f"{p.score}::double as base, v, "
            "(list_sum(list_transform(g[1:i], lambda x: length(x))) + "
            "coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0))::bigint as start "
            "from (select *, m[i] as v from (select *, unnest(range(1, len(m) + 1)) as i from "
            f"(select id, text, regexp_extract_all(text, {r}) as m, "
            f"regexp_split_to_array(text, {r}) as g from {src} where regexp_matches(text, {r})))) "
            f"where {_test(p)}"
        )
    helped = "false"
    kinds = sorted({p.entity_type for p in chosen if p.context})
    if context and kinds:
        cases = " ".join(
            f"when {q(t)} then regexp_matches(w, {q('|'.join(x.lower() for x in CONTEXT_WORDS[t]))})"
            for t in kinds)
        helped = f"case entity_type {cases} else false end"
    window = (
        "lower(array_to_string(list_reverse(list_reverse(list_filter(regexp_split_to_array("
        "substring(text, 1, start), '\\s+'), "
        "lambda x: x <> ''))[1:5]), ' '))"
    )
    return f"""raw as ({' union all '.join(parts)}),
windowed as (select *, {window} as w from raw),
scored as (select id, entity_type, rank, start, start + length(v) as end_, v as value,
  round(case when {helped} then least(greatest(base + 0.35, 0.4), 1.0) else base end, 4) as score from windowed),
det as (select * from scored where score >= {threshold})"""


def resolved(src: str, det: str = "det") -> str:
    """CTEs ending in ``res(id, entity_type, start, end_, score, value)``."""
    order = "partition by id order by start, end_ desc, rank, score, value"
    return f"""reach as (select *, max(end_) over ({order} rows between unbounded preceding and 1 preceding) as r from {det}),
isle as (select *, sum(case when r is null or start >= r then 1 else 0 end) over ({order} rows between unbounded preceding and current row) as n from reach),
ranked as (select *, min(start) over (partition by id, n) as s0, max(end_) over (partition by id, n) as e0,
  row_number() over (partition by id, n order by end_ - start desc, score desc, rank) as k from isle),
res as (select a.id, a.entity_type, a.s0 as start, a.e0 as end_, a.score, substring(t.text, a.s0 + 1, a.e0 - a.s0) as value
  from ranked a join {src} t on a.id = t.id where k = 1)"""


def key(value: str, kind: str, secret: str = "") -> str:
    return f"sha256({q(secret)} || {value} || '|' || {kind})" if secret else \
        f"sha256({value} || '|' || {kind})"


def u(h: str, k: int) -> str:
    return f"('0x' || substr({h}, {1 + 8 * k}, 8))::bigint"


def pad(n: str, w: int) -> str:
    return f"lpad(({n})::varchar, {w}, '0')"


def pick(pool, n: str) -> str:
    return f"({lst(pool)})[({n}) % {len(pool)} + 1]"


def letter(n: str) -> str:
    return f"chr((65 + ({n}) % 26)::int)"


def number(quad: str) -> str:
    return (f"(case when regexp_matches({quad}, '^(?:(?:0|[1-9]\\d?|1\\d\\d|2[0-4]\\d|25[0-5])\\.){{3}}"
            f"(?:0|[1-9]\\d?|1\\d\\d|2[0-4]\\d|25[0-5])$') then "
            + " + ".join(f"split_part({quad}, '.', {i})::bigint * {256 ** (4 - i)}" for i in (1, 2, 3, 4))
            + " end)")


def _n(quad: str) -> int:
    a, b, c, d = (int(x) for x in quad.split("."))
    return ((a * 256 + b) * 256 + c) * 256 + d


def private(quad: str) -> str:
    tests = " or ".join(f"{number(quad)} between {_n(a)} and {_n(b)}" for a, b in PRIVATE_RANGES)
    return f"coalesce({tests}, false)"


def prefix(ip: str) -> str:
    t = f"regexp_extract({ip}, '^[^/]*/(\\d{{1,2}})$', 1)"
    return f"(case when {t} <> '' and try_cast({t} as int) <= 32 then try_cast({t} as int) end)"


def block(n: str) -> str:
    return f"(1::bigint << (32 - {n}))"


def network(ip: str) -> str:
    return f"coalesce({number(f'split_part({ip}, {q(chr(47))}, 1)')} % {block(prefix(ip))} = 0, false)"


def quad(n: str) -> str:
    return " || '.' || ".join(f"((({n}) // {256 ** e}) % 256)::varchar" for e in (3, 2, 1, 0))


def _host(h: str, is_private: str) -> str:
    octet = f"({list(PUBLIC_OCTETS)})[{u(h, 0)} % {len(PUBLIC_OCTETS)} + 1]"
    a, b, c = f"{u(h, 1)} % 256", f"{u(h, 2)} % 256", f"1 + {u(h, 3)} % 254"
    return (f"(case when not ({is_private}) then {octet}::varchar || '.' || ({a})::varchar || '.' || ({b})::varchar || '.' || ({c})::varchar "
            f"when {u(h, 0)} % 3 = 0 then '10.' || ({a})::varchar || '.' || ({b})::varchar || '.' || ({c})::varchar "
            f"when {u(h, 0)} % 3 = 1 then '172.' || (16 + {u(h, 1)} % 16)::varchar || '.' || ({b})::varchar || '.' || ({c})::varchar "
            f"else '192.168.' || ({b})::varchar || '.' || ({c})::varchar end)")


def _version_six(ip: str, h: str) -> str:
    g = [f"substr({h}, {1 + 4 * n}, 4)" for n in range(8)]
    n = f"try_cast(regexp_extract({ip}, '::/([0-9]+)$', 1) as int)"
    tail = f"(case when contains({ip}, '/') then substr({ip}, instr({ip}, '/')) else '' end)"
    site = f"'fd' || left({h}, 2) || ':' || {g[1]}"
    docs = f"'2001:db8:' || {g[0]}"
    rest = " || ':' || ".join(g[2:7])

    def made(head: str, short: str, more: str) -> str:
        return (f"(case when {n} >= 64 then {head} || ':' || {g[2]} || '::/' || {n} "
                f"when {n} >= 48 then {head} || '::/' || {n} "
                f"when {n} is not null then {short} || '::/' || {n} "
                f"else {head} || ':' || {rest}{more} || {tail} end)")

    return (f"(case when regexp_matches(lower({ip}), '^(fc|fd|fe8|fe9|fea|feb)') then "
            + made(site, f"(case when {n} >= 8 then 'fd00' else 'fc00' end)", f" || ':' || {g[7]}")
            + " else " + made(docs, f"(case when {n} >= 32 then '2001:db8' when {n} >= 16 "
                              "then '2001' else '2000' end)", "") + " end)")


def substitute_ip(ip: str, h: str) -> str:
    return (f"(case when contains({ip}, ':') then {_version_six(ip, h)} "
            f"else {_version_four(ip, h)} end)")


def _version_four(ip: str, h: str) -> str:
    addr = f"split_part({ip}, '/', 1)"
    octet = f"({list(PUBLIC_OCTETS)})[{u(h, 0)} % {len(PUBLIC_OCTETS)} + 1]"
    a, b, c = f"{u(h, 1)} % 256", f"{u(h, 2)} % 256", f"{u(h, 3)} % 256"
    kind = (f"(case when {prefix(ip)} < 12 then 0 when {prefix(ip)} < 16 then {u(h, 0)} % 2 "
            f"else {u(h, 0)} % 3 end)")
    base = (f"(case when not {private(addr)} then {octet}::bigint * 16777216 + {a} * 65536 + {b} * 256 + {c} "
            f"when {kind} = 0 then {_n('10.0.0.0')} + {a} * 65536 + {b} * 256 + {c} "
            f"when {kind} = 1 then {_n('172.16.0.0')} + {u(h, 1)} % 16 * 65536 + {b} * 256 + {c} "
            f"else {_n('192.168.0.0')} + {b} * 256 + {c} end)")
    masked = f"({base} // {block(prefix(ip))} * {block(prefix(ip))})"
    found = f"regexp_extract({addr}, '(\\d{{1,3}}\\.\\d{{1,3}}\\.\\d{{1,3}}\\.\\d{{1,3}})', 1)"
    tail = f"(case when contains({ip}, '/') then substr({ip}, instr({ip}, '/')) else '' end)"
    return (f"(case when {network(ip)} then {quad(masked)} || '/' || {prefix(ip)}::varchar "
            f"when {found} = '' then {_host(h, 'false')} "
            f"else {_host(h, private(found))} || {tail} end)")


def luhn_digit(d: str) -> str:
    """Digits from the right, the first doubled."""
    total = (f"list_sum(list_transform(range(1, length({d}) + 1), lambda i: "
             f"case when i % 2 = 1 then (substr(reverse({d}), i, 1)::int * 2) % 10 "
             f"+ (substr(reverse({d}), i, 1)::int * 2) // 10 "
             f"else substr(reverse({d}), i, 1)::int end))")
    return f"((10 - {total} % 10) % 10)::int::varchar"


def substitutes(v: str, h: str, locale: str = "en_US") -> dict[str, str]:
    fh, ft, lh, lt = NAME_PARTS[language_of(locale)]
    seven = lambda k: pad(f"{u(h, k)} % 10000000", 7)
    card = f"'4' || {seven(0)} || {seven(1)}"
    iban_body = f"(({u(h, 0)} % 1000000000)::hugeint * 1000000000 + {u(h, 1)} % 1000000000)"
    cities = cities_of(locale)
    city = f"{u(h, 0)} % {len(cities)} + 1"
    col = lambda i: f"({lst(c[i] for c in cities)})[{city}]"
    number = f"(1 + {u(h, 0)} % 9999)::varchar"
    before, names = STREET_NAMES.get(language_of(locale), (True, ()))
    street = (f"{pick(names, u(h, 1))}" if names
              else f"{pick(STREETS, u(h, 1))} || ' ' || {pick(STREET_SUFFIXES, u(h, 2))}")
    return {
        "PERSON": f"{pick(fh, u(h, 0))} || {pick(ft, u(h, 1))} || ' ' || {pick(lh, u(h, 2))} || {pick(lt, u(h, 3))}",
        "EMAIL_ADDRESS": f"'user_' || substr({h}, 1, 10) || '@example.net'",
        "PHONE_NUMBER": f"printf({q(PHONE_FORMATS[locale])}, {u(h, 0)} % 1000, {u(h, 1)} % 10000)",
        "CREDIT_CARD": f"{card} || {luhn_digit(f'({card})')}",
        "US_SSN": f"{pad(f'900 + {u(h, 0)} % 100', 3)} || '-' || {pad(f'1 + {u(h, 1)} % 99', 2)} || '-' || {pad(f'1 + {u(h, 2)} % 9999', 4)}",
        "US_BANK_NUMBER": " || ".join(letter(u(h, k)) for k in range(4)) + f" || {seven(4)} || {seven(5)}",
        "US_DRIVER_LICENSE": f"{letter(u(h, 0))} || {pad(f'{u(h, 1)} % 1000000', 6)} || {pad(f'{u(h, 2)} % 1000000', 6)}",
        "US_ITIN": f"'9' || {pad(f'{u(h, 0)} % 100', 2)} || '-' || (70 + {u(h, 1)} % 30)::varchar || '-' || (1000 + {u(h, 2)} % 9000)::varchar",
        "US_PASSPORT": f"{letter(u(h, 0))} || {pad(f'{u(h, 1)} % 100000000', 8)}",
        "IP_ADDRESS": substitute_ip(v, h),
        "LOCATION": col(0),
        "STREET_ADDRESS": f"{number} || ' ' || {street}" if before else f"{street} || ' ' || {number}",
        "DATE_TIME": f"strftime(date '1970-01-01' + ({u(h, 0)} % 20000)::int, '%Y-%m-%d')",
        "NRP": pick(GROUPS, u(h, 0)),
        "MEDICAL_LICENSE": f"'ML' || {pad(f'{u(h, 0)} % 100000000', 8)}",
        "URL": f"'https://' || substr({h}, 1, 10) || '.example.org/'",
        "IBAN_CODE": f"'DE' || {pad(f'(98 - ({iban_body} * 1000000 + 131400) % 97)', 2)} || {pad(iban_body, 18)}",
        "CRYPTO": f"{pick(WALLET_PREFIXES, u(f'sha256({h})', 0))} || array_to_string(list_transform(range(1, 33), lambda i: substr({q(BASE58)}, ('0x' || substr({h}, 2 * i - 1, 2))::int % 58 + 1, 1)), '')",
        "GUID": f"substr({h}, 1, 8) || '-' || substr({h}, 9, 4) || '-4' || substr({h}, 14, 3) || '-' || {pick(('8', '9', 'a', 'b'), u(h, 2))} || substr({h}, 18, 3) || '-' || substr({h}, 21, 12)",
        "COORDINATE": f"case when abs(try_cast({v} as double)) > 90 then {col(2)} else {col(1)} end",
    }


def default_substitute(h: str) -> str:
    return f"'<REDACTED_' || {pad(f'{u(h, 0)} % 1000000', 6)} || '>'"


def substitute(v: str, kind: str, h: str, types=None, locale: str = "en_US") -> str:
    made = substitutes(v, h, locale)
    if types is not None:
        made = {t: e for t, e in made.items() if t in set(types)}
    cases = " ".join(f"when {q(t)} then {e}" for t, e in made.items())
    return f"(case {kind} {cases} else {default_substitute(h)} end)" if cases else \
        default_substitute(h)


def keyed(secret: str = "", types=None, threshold: float = DEFAULT_THRESHOLD, kinds=()) -> str:
    """CTEs ending in ``sub``: resolved spans with key and substitute."""
    wanted = sorted({p.entity_type for p in select_patterns(types, threshold)} | set(kinds))
    return f"""hashed as (select *, {key('value', 'entity_type', secret)} as h from res),
sub as (select *, {substitute('value', 'entity_type', 'h', wanted)} as substitute from hashed)"""


def rewritten(src: str) -> str:
    """CTE ``done(id, anonymized_text)`` from ``sub``."""
    return f"""placed as (select s.*, t.text, coalesce(lag(end_) over (partition by s.id order by start), 0) as prev
  from sub s join {src} t on s.id = t.id),
joined as (select id, string_agg(substring(text, prev + 1, start - prev) || substitute, '' order by start) as head,
  max(end_) as last from placed group by id),
done as (select t.id, case when j.id is null then t.text else j.head || substring(t.text, j.last + 1, 2000000) end as anonymized_text
  from {src} t left join joined j on t.id = j.id)"""


def full(src_sql: str, types=None, threshold: float = DEFAULT_THRESHOLD, secret: str = "") -> str:
    """All CTEs from a source to the rewritten text, starting with ``with``."""
    return (f"with src as ({src_sql}),\n{detections('src', types, threshold)},\n{resolved('src')},\n"
            f"{keyed(secret, types, threshold)},\n{rewritten('src')}\n")
