"""Queries on substitutes, strategies and rewriting."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, functions as F

from ..functions import ip as ipf
from ..functions.keys import mapping_id, mapping_key
from ..functions.names import is_latin
from ..functions.pools import LOCALES
from ..functions.strategies import apply_strategy, by_type
from ..functions.substitutes import place, substitute
from ..operators.cleaning import (
    CleanConfig,
    clean_texts,
    detect,
    explode_spans,
    output_offsets,
    resolved,
    segments,
    with_spans,
)
from ..operators.names import name_origin, person_substitutes, top_names
from ..operators.origin import BUCKETS, SCALE, SMOOTHING, OriginModel, origin_with_model
from ..sources.derived import IPS, MESSAGES, NAMES, PROBE, Derived, s, table
from ..sources.files import spread
from . import oracle as o
from .registry import query

MESSAGE_CTES = o.full(MESSAGES.sql)


def cleaned_messages(spark, folder, config: CleanConfig = CleanConfig()) -> DataFrame:
    return clean_texts(MESSAGES.frame(spark, folder), config)


_COUNTS = """, n as (select id, count(*) as d from det group by id), k as (select id, count(*) as a from res group by id)
select done.id as {id}, anonymized_text, coalesce(d, 0) as entities_detected, coalesce(a, 0) as entities_anonymized
 from done left join n using (id) left join k using (id)"""


def _anonymize(name: str, source: str, select: str, columns: list[str], id_name: str) -> None:
    @query(name, o.full(select) + _COUNTS.format(id=id_name))
    def run(spark, folder):
        texts = spread(table(spark, folder, source).selectExpr(*columns))
        return clean_texts(texts).select(
            F.col("id").alias(id_name), "anonymized_text", "entities_detected",
            "entities_anonymized")


_anonymize("anonymize_documents", "documents", "select doc_id as id, text from documents",
           ["doc_id as id", "text"], "doc_id")
_anonymize("anonymize_pages", "pages", "select page_id as id, html as text from pages",
           ["page_id as id", "html as text"], "page_id")
_anonymize("anonymize_benchmark", "benchmark", "select item_id as id, text from benchmark",
           ["item_id as id", "text"], "item_id")
_anonymize("anonymize_turns", "conversations",
           "select conv_id * 1000 + turn as id, text || ' mail me at u' || cast(conv_id as string) || '@example.com' as text from conversations",
           ["conv_id * 1000 + turn as id",
            "text || ' mail me at u' || cast(conv_id as string) || '@example.com' as text"],
           "turn_id")


@query("anonymize_messages", MESSAGE_CTES + _COUNTS.format(id="id"))
def anonymize_messages(spark, folder):
    return cleaned_messages(spark, folder).select(
        "id", "anonymized_text", "entities_detected", "entities_anonymized")


@query("substitutions", MESSAGE_CTES + """select id, start, end_ as "end", entity_type,
 end_ - start as original_length, substitute from sub""")
def substitutions(spark, folder):
    return explode_spans(cleaned_messages(spark, folder), "substitutions", "id").select(
        "id", "start", "end", "entity_type",
        F.col("original_length").cast("bigint").alias("original_length"), "substitute")


@query("batch_totals", MESSAGE_CTES + """select (select count(*) from src) as texts,
 (select count(*) from det) as entities_detected, (select count(*) from res) as entities_anonymized,
 (select sum(length(text))::bigint from src) as input_length""")
def batch_totals(spark, folder):
    counted = with_spans(MESSAGES.frame(spark, folder)).select(
        F.length("text").alias("n"), F.size("found").alias("d"), F.size("spans").alias("a"))
    return counted.agg(
        F.count("*").alias("texts"), F.sum("d").alias("entities_detected"),
        F.sum("a").alias("entities_anonymized"), F.sum("n").alias("input_length"))


@query("output_offsets", MESSAGE_CTES + """select id, entity_type, start, start + shift as out_start,
 start + shift + length(substitute) as out_end from (select *, coalesce(sum(length(substitute) - (end_ - start))
 over (partition by id order by start rows between unbounded preceding and 1 preceding), 0)::bigint as shift from sub)""")
def output_offsets_query(spark, folder):
    return (
        cleaned_messages(spark, folder)
        .select("id", F.explode_outer(output_offsets(F.col("substitutions"))).alias("x"))
        .filter(F.col("x").isNotNull()).select("id", "x.*")
    )


@query("text_segments", MESSAGE_CTES + """, cuts as (select id, prev as pos, 0 as half, false as replaced,
 substring(text, prev + 1, start - prev) as segment from placed
 union all select id, start, 1, true, substitute from placed
 union all select t.id, coalesce(last, 0), 2, false, substring(t.text, coalesce(last, 0) + 1, 2000000) from src t left join joined using (id))
select id, (row_number() over (partition by id order by pos, half) - 1) as position, replaced, segment from cuts where segment <> ''""")
def text_segments(spark, folder):
    # The original text is needed beside the substitutions, so it is kept twice.
    texts = MESSAGES.frame(spark, folder).withColumn("original", F.col("text"))
    return (
        clean_texts(texts)
        .select("id", F.posexplode_outer(segments(F.col("original"), F.col("substitutions"))))
        .select("id", F.col("pos").cast("bigint").alias("position"), "col.replaced",
                "col.segment")
    )


@query("side_by_side", MESSAGE_CTES
       + "select id, start, entity_type, value as original, substitute from sub")
def side_by_side(spark, folder):
    texts = MESSAGES.frame(spark, folder).withColumn("source", F.col("text"))
    rows = explode_spans(clean_texts(texts), "substitutions", "id", "source")
    return rows.select(
        "id", "start", "entity_type",
        F.substring(F.col("source"), (F.col("start") + 1).cast("int"),
                    (F.col("end") - F.col("start")).cast("int")).alias("original"),
        "substitute")


# Substitutes of every type, from one value per customer.
_GROUPS = {
    "identity": ["PERSON", "NRP", "EMAIL_ADDRESS", "PHONE_NUMBER"],
    "us_numbers": ["US_SSN", "US_BANK_NUMBER", "US_DRIVER_LICENSE", "US_ITIN", "US_PASSPORT",
                   "MEDICAL_LICENSE"],
    "payment": ["CREDIT_CARD", "IBAN_CODE", "CRYPTO"],
    "places": ["LOCATION", "STREET_ADDRESS", "COORDINATE"],
    "technical": ["URL", "GUID", "DATE_TIME", "OTHER_TYPE"],
}


def _substitute_query(group: str, types: list[str]) -> None:
    kinds = " union all ".join(
        f"select c_custkey as id, {o.q(t)} as t, "
        + ("cast(c_custkey % 180 as string) || '.5'" if t == "COORDINATE" else "c_name")
        + " as v from customer" for t in types)
    sql = (f"with kinds as ({kinds}), hashed as (select *, {o.key('v', 't')} as h from kinds) "
           f"select id, t as entity_type, {o.substitute('v', 't', 'h', types)} as substitute "
           "from hashed")

    @query(f"substitutes_{group}", sql)
    def run(spark, folder):
        values = table(spark, folder, "customer").select(
            F.col("c_custkey").alias("id"), "c_name",
            F.explode(F.array(*[F.lit(t) for t in types])).alias("entity_type"))
        v = F.when(F.col("entity_type") == "COORDINATE",
                   F.expr("cast(id % 180 as string) || '.5'")).otherwise(F.col("c_name"))
        return values.select("id", "entity_type", v.alias("v")).select(
            "id", "entity_type",
            substitute(F.col("v"), F.col("entity_type"),
                       mapping_key(F.col("v"), F.col("entity_type")), types=types)
            .alias("substitute"))


for _group, _types in _GROUPS.items():
    _substitute_query(_group, _types)


@query("substitutes_locales", "with v as (select c_custkey as id, c_name as v, "
       + f"{o.key('c_name', o.q('PERSON'))} as h from customer) "
       + " union all ".join(
           f"select id, {o.q(c)} as locale, {o.substitutes('v', 'h', c)['PERSON']} as person, "
           f"{o.substitutes('v', 'h', c)['PHONE_NUMBER']} as phone from v" for c in LOCALES))
def substitutes_locales(spark, folder):
    values = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("v"),
        mapping_key(F.col("c_name"), F.lit("PERSON")).alias("h"))

    def made(locale: str, kind: str):
        return substitute(F.col("v"), F.lit(kind), F.col("h"), locale, [kind])

    rows = F.array(*[
        F.struct(F.lit(c).alias("locale"), made(c, "PERSON").alias("person"),
                 made(c, "PHONE_NUMBER").alias("phone")) for c in LOCALES])
    return values.select("id", F.explode(rows).alias("r")).select("id", "r.*")


_PLACE_KINDS = ("LOCATION", "STREET_ADDRESS", "COORDINATE")


@query("substitutes_places_locales", "with v as (select c_custkey as id, (c_custkey % 360 - 180)::varchar || '.5' as v, "
       + f"{o.key('c_name', o.q('LOCATION'))} as h from customer) "
       + " union all ".join(
           f"select id, {o.q(c)} as locale, " + ", ".join(
               f"{o.substitutes('v', 'h', c)[k]} as {k.lower()}" for k in _PLACE_KINDS) + " from v" for c in LOCALES))
def substitutes_places_locales(spark, folder):
    """Cities, streets and coordinates of every locale."""
    values = table(spark, folder, "customer").select(
        F.col("c_custkey").alias("id"), F.expr("cast(c_custkey % 360 - 180 as string) || '.5'").alias("v"),
        mapping_key(F.col("c_name"), F.lit("LOCATION")).alias("h"))
    rows = F.array(*[F.struct(F.lit(c).alias("locale"), *[
        substitute(F.col("v"), F.lit(k), F.col("h"), c, [k]).alias(k.lower()) for k in _PLACE_KINDS]) for c in LOCALES])
    return values.select("id", F.explode(rows).alias("r")).select("id", "r.*")


@query("substitutes_seeded", f"select c_custkey as id, {o.substitutes('c_name', o.key('c_name', o.q('PERSON'), 'pepper'))['PERSON']} as person from customer")
def substitutes_seeded(spark, folder):
    key = mapping_key(F.col("c_name"), F.lit("PERSON"), "pepper")
    return table(spark, folder, "customer").select(
        F.col("c_custkey").alias("id"),
        substitute(F.col("c_name"), F.lit("PERSON"), key, types=["PERSON"]).alias("person"))


@query("location_struct", "with v as (select c_custkey as id, "
       + f"{o.key('c_name', o.q('LOCATION'))} as h from customer) select id, "
       + ", ".join(f"({o.lst(c[i] for c in __import__('veilspark.functions.pools', fromlist=['CITIES']).CITIES)})[{o.u('h', 0)} % 16 + 1] as {n}"
                   for i, n in enumerate(("name", "latitude", "longitude", "country_code")))
       + " from v")
def location_struct(spark, folder):
    drawn = place(mapping_key(F.col("c_name"), F.lit("LOCATION")))
    return table(spark, folder, "customer").select(
        F.col("c_custkey").alias("id"), drawn.alias("p")).select("id", "p.*")


# IPv4 helpers.
def _ips(spark, folder):
    return IPS.frame(spark, folder)


@query("ip_split", f"select id, ip, split_part(ip, '/', 1) as address, case when contains(ip, '/') then substr(ip, instr(ip, '/')) end as suffix from ({IPS.sql})")
def ip_split(spark, folder):
    ip = F.col("ip")
    return _ips(spark, folder).select(
        "id", "ip", ipf.address(ip).alias("address"), ipf.suffix(ip).alias("suffix"))


@query("ip_classify", f"with v as (select id, split_part(ip, '/', 1) as a from ({IPS.sql})) select id, a as address, {o.private('a')} as private from v")
def ip_classify(spark, folder):
    a = ipf.address(F.col("ip"))
    return _ips(spark, folder).select(
        "id", a.alias("address"), ipf.is_private(a).alias("private"))


@query("ip_network_test", f"select id, ip, {o.network('ip')} as network, case when {o.network('ip')} then {o.prefix('ip')} end as prefix from ({IPS.sql})")
def ip_network_test(spark, folder):
    ip = F.col("ip")
    return _ips(spark, folder).select(
        "id", "ip", ipf.is_network(ip).alias("network"),
        F.when(ipf.is_network(ip), ipf.prefix_length(ip)).alias("prefix"))


_V6 = PROBE["ipv6"]


@query("ip6_substitute", f"with src as ({_V6.sql}),\n{o.detections('src', ['IP_ADDRESS'])},\n"
       f"hashed as (select *, {o.key('value', 'entity_type')} as h from det)\n"
       f"select id, value as ip, {o.substitute_ip('value', 'h')} as substitute from hashed")
def ip6_substitute(spark, folder):
    found = explode_spans(detect(_V6.frame(spark, folder), CleanConfig(["IP_ADDRESS"])),
                          "detections", "id")
    key = mapping_key(F.col("text"), F.col("entity_type"))
    return found.select("id", F.col("text").alias("ip"),
                        ipf.substitute_ip(F.col("text"), key).alias("substitute"))


@query("ip_substitute", f"with v as (select id, ip, {o.key('ip', o.q('IP_ADDRESS'))} as h from ({IPS.sql})) select id, ip, {o.substitute_ip('ip', 'h')} as substitute from v")
def ip_substitute(spark, folder):
    key = mapping_key(F.col("ip"), F.lit("IP_ADDRESS"))
    return _ips(spark, folder).select(
        "id", "ip", ipf.substitute_ip(F.col("ip"), key).alias("substitute"))


# Names.
@query("script_detect", f"""with v as (select id, name, length(regexp_replace(name, '[\\s\\-''.]', '', 'g')) as n,
 length(regexp_replace(name, '[^A-Za-z\\x{{00C0}}-\\x{{024F}}]', '', 'g')) as l from ({NAMES.sql}))
 select id, name, case when n = 0 then true else l / n > 0.8 end as latin from v""")
def script_detect(spark, folder):
    return NAMES.frame(spark, folder).select("id", "name", is_latin(F.col("name")).alias("latin"))


# The dictionary: how many customers of a nation carry a part.
_DICTIONARY = f"""names as ({NAMES.sql}), words as (select *, unnest(regexp_split_to_array(trim(name), '\\s+')) as part,
 unnest(range(1, len(regexp_split_to_array(trim(name), '\\s+')) + 1)) as i from names),
dict as (select part, case when i = 1 then 'first' else 'last' end as kind, 'N' || lpad(cast(nation as string), 2, '0') as country,
 count(*) as score from words where part <> '' group by 1, 2, 3)"""


def _dictionary(spark, folder) -> DataFrame:
    names = NAMES.frame(spark, folder)
    return (
        names.select("nation", F.posexplode(F.split(F.trim("name"), r"\s+")).alias("i", "part"))
        .filter("part <> ''")
        .groupBy("part", F.when(F.col("i") == 0, "first").otherwise("last").alias("kind"),
                 F.expr("'N' || lpad(cast(nation as string), 2, '0')").alias("country"))
        .agg(F.count("*").alias("score"))
    )


_ORIGIN = _DICTIONARY + """, parts as (select id, unnest(regexp_split_to_array(trim(name), '\\s+')) as part from names),
totals as (select id, country, sum(score)::bigint as score from parts join dict using (part) where length(part) >= 2 group by 1, 2),
origin as (select id, country, score from totals qualify row_number() over (partition by id order by score desc, country) = 1)"""


@query("name_origin", f"with {_ORIGIN} select * from origin")
def name_origin_query(spark, folder):
    return name_origin(NAMES.frame(spark, folder), _dictionary(spark, folder), "id")


_LATIN = """case when length(regexp_replace({0}, '[\\s\\-''.]', '', 'g')) = 0 then true
 else length(regexp_replace({0}, '[^A-Za-z\\x{{00C0}}-\\x{{024F}}]', '', 'g')) / length(regexp_replace({0}, '[\\s\\-''.]', '', 'g')) > 0.8 end"""
_TOP = """select *, row_number() over (partition by country, kind order by score desc, part) as place
 from dict where {} qualify place <= {}"""


@query("name_pool_top", f"with {_DICTIONARY} {_TOP.format(_LATIN.format('part'), 5)}")
def name_pool_top(spark, folder):
    return top_names(_dictionary(spark, folder), 5, latin_only=True)


def _pool(where: str) -> str:
    return (f"select country, list(part order by place) filter (where kind = 'first') as f, "
            f"list(part order by place) filter (where kind = 'last') as l "
            f"from ({_TOP.format(where, 100)}) group by 1")


@query("substitutes_person_origin", f"""with {_ORIGIN}, every as ({_pool('true')}), latin as ({_pool(_LATIN.format('part'))}),
picked as (select n.id, n.name, g.country, {_LATIN.format('n.name')} as is_latin, {o.key('n.name', o.q('PERSON'))} as h
 from names n left join origin g on n.id = g.id),
pools as (select p.*, case when is_latin then latin.f else every.f end as f, case when is_latin then latin.l else every.l end as l
 from picked p left join every on p.country = every.country left join latin on p.country = latin.country)
select id, country, case when len(f) > 0 and len(l) > 0 then f[{o.u('h', 0)} % len(f) + 1] || ' ' || l[{o.u('h', 1)} % len(l) + 1]
 else {o.substitutes('name', 'h')['PERSON']} end as substitute from pools""")
def substitutes_person_origin(spark, folder):
    return person_substitutes(NAMES.frame(spark, folder), _dictionary(spark, folder), "id", n=100)


_RUNS = "list_transform(range(1, length({0}) + 1), lambda i: ('0x' || left(md5(substr('^' || lower({0}) || '$', i, 3)), 4))::int % {1})"
_LOG = "round({0} * ln(({1} + {2}) / (total + {2} * {3})))::bigint".format
_MODEL = f"""runs as (select country, b, count(*) as n from (select country, unnest({_RUNS.format('part', BUCKETS)}) as b
  from (select distinct lower(part) as part, country from dict)) group by 1, 2),
bases as (select country, sum(n) as total, {_LOG(SCALE, 0, SMOOTHING, BUCKETS)} as base from runs group by 1),
more as (select b, country, {_LOG(SCALE, 'n', SMOOTHING, BUCKETS)} - base as more from runs join bases using (country)),
asked as (select id, unnest({_RUNS.format('part', BUCKETS)}) as b from (select id, unnest(regexp_split_to_array(name, '\\s+')) as part from unknown)
  where length(part) >= 2),
likely as (select a.id, c.country, count(*) * any_value(base) + coalesce(sum(more), 0) as l from asked a cross join bases c
  left join more m on m.b = a.b and m.country = c.country group by 1, 2),
told as (select id, country from likely qualify row_number() over (partition by id order by l desc, country) = 1)"""
# Names of which the dictionary holds all parts, some or none.
_UNKNOWN = Derived("customer", {"k": "c_custkey"}, {"id": "k", "name": f"""case k % 5 when 0 then 'Иван Петро' || {s('k % 9')} when 1 then ''
 when 2 then 'fa' || {s('k % 40')} when 3 then 'Fa' || {s('k % 13')} || '  Zed' else 'Éta-Lu Lala' || {s('k')} end"""})
_PERSON_TEXT = "'Met ' || name || ' on 2024-01-0' || {0} || ' at a@b.org'".format


@query("name_origin_unknown", f"""with {_DICTIONARY}, unknown as ({_UNKNOWN.sql}), {_MODEL},
parts as (select id, unnest(regexp_split_to_array(trim(name), '\\s+')) as part from unknown),
totals as (select id, country, sum(score)::bigint as score from parts join dict using (part) where length(part) >= 2 group by 1, 2),
known as (select id, country, score from totals qualify row_number() over (partition by id order by score desc, country) = 1)
select * from known union all select id, country, null from told where id not in (select id from known)""")
def name_origin_unknown(spark, folder):
    names, known = _UNKNOWN.frame(spark, folder), _dictionary(spark, folder)
    return origin_with_model(names, name_origin(names, known, "id"), OriginModel(known), "id")


@query("anonymize_person_origin", f"""with unknown as (select * from ({_UNKNOWN.sql}) where name <> ''), {_DICTIONARY}, {_MODEL},
every as ({_pool('true')}), latin as ({_pool(_LATIN.format('part'))}),
picked as (select u.id, u.name, t.country, {_LATIN.format('u.name')} as is_latin, {o.key('u.name', o.q('PERSON'))} as h from unknown u left join told t on u.id = t.id),
pools as (select p.*, case when is_latin then latin.f else every.f end as f, case when is_latin then latin.l else every.l end as l
 from picked p left join every on p.country = every.country left join latin on p.country = latin.country),
chosen as (select id, name, case when len(f) > 0 and len(l) > 0 then f[{o.u('h', 0)} % len(f) + 1] || ' ' || l[{o.u('h', 1)} % len(l) + 1]
 else {o.substitutes('name', 'h')['PERSON']} end as name_new from pools)
select id, 'Met ' || name_new || ' on ' || '2024-01-0' || (1 + id % 9)::varchar || ' at ' || {o.substitutes("'a@b.org'", o.key("'a@b.org'", "'EMAIL_ADDRESS'"))['EMAIL_ADDRESS']} as anonymized_text from chosen""")
def anonymize_person_origin(spark, folder):
    """Persons in texts, found elsewhere, get names of their origin and script."""
    names = _UNKNOWN.frame(spark, folder).filter("name <> ''")
    texts = names.select("id", F.expr(_PERSON_TEXT("cast(1 + id % 9 as string)")).alias("text"), F.array(F.struct(
        F.lit("PERSON").alias("entity_type"), F.lit(4).alias("start"), (F.length("name") + 4).alias("end"),
        F.lit(0.9).alias("score"))).alias("given"))
    config = CleanConfig(entity_types=["PERSON", "EMAIL_ADDRESS"], origin=OriginModel(_dictionary(spark, folder)))
    return clean_texts(texts, config, extra="given").select("id", "anonymized_text")


# Strategies, over every resolved value of the messages.
def _values(spark, folder) -> DataFrame:
    return explode_spans(resolved(MESSAGES.frame(spark, folder)), "spans", "id")


_VALUES = f"with src as ({MESSAGES.sql}),\n{o.detections('src')},\n{o.resolved('src')}\n"


def _strategy(name: str, sql: str | None, **outputs) -> None:
    full = None if sql is None else f"{_VALUES}select id, start, entity_type, {sql} from res"

    @query(name, full)
    def run(spark, folder):
        v, t = F.col("text"), F.col("entity_type")
        return _values(spark, folder).select(
            "id", "start", "entity_type",
            *[apply_strategy(s, v, t, p).alias(n) for n, (s, p) in outputs.items()])


_strategy("strategy_mask", """case when length(value) > 4 then repeat('*', length(value) - 4) || right(value, 4) else value end as masked,
 repeat('#', least(6, length(value))) || substr(value, 7) as head,
 left(value, length(value) - least(3, length(value))) || repeat('*', least(3, length(value))) as tail,
 value as none""",
          masked=("mask", {}), head=("mask", {"masking_char": "#", "chars_to_mask": 6}),
          tail=("mask", {"chars_to_mask": 3, "from_end": True}),
          none=("mask", {"chars_to_mask": 0}))
_strategy("strategy_hash", "sha256(value) as sha256, md5(value) as md5, left(sha256(value), 12) as short",
          sha256=("hash", {}), md5=("hash", {"hash_type": "md5"}),
          short=("hash", {"truncate": 12}))
_strategy("strategy_hash_512", None, sha512=("hash", {"hash_type": "sha512"}))
# The other engine lacks SHA-512: literal digests of the names that the table holds.
_DIGESTS = ", ".join(f"('NATION_{i}', '{hashlib.sha512(f'NATION_{i}'.encode()).hexdigest()}')" for i in range(25))


@query("strategy_hash_512_names", f"select n_nationkey, digest as sha512, left(digest, 20) as short from nation join (values {_DIGESTS}) d(name, digest) on name = n_name")
def strategy_hash_512_names(spark, folder):
    hashed = lambda **more: apply_strategy(
        "hash", F.col("n_name"), F.lit("NRP"), {"hash_type": "sha512", **more})
    return table(spark, folder, "nation").select(
        "n_nationkey", hashed().alias("sha512"), hashed(truncate=20).alias("short"))


_strategy("strategy_redact", """'[REDACTED]' as plain, '[' || entity_type || '_REDACTED]' as typed, '' as empty""",
          plain=("redact", {}), typed=("redact", {"include_type": True}),
          empty=("redact", {"placeholder": ""}))


@query("strategy_replace", MESSAGE_CTES + "select id, start, entity_type, substitute as replaced from sub")
def strategy_replace(spark, folder):
    return explode_spans(cleaned_messages(spark, folder), "substitutions", "id").select(
        "id", "start", "entity_type", F.col("substitute").alias("replaced"))


CHOICES = {
    "CREDIT_CARD": ("mask", None),
    "US_SSN": ("redact", {"include_type": True}),
    "GUID": ("hash", {"truncate": 16}),
}


@query("strategy_by_type", MESSAGE_CTES + """select id, start, entity_type, case entity_type
 when 'CREDIT_CARD' then repeat('*', length(value) - 4) || right(value, 4) when 'US_SSN' then '[US_SSN_REDACTED]'
 when 'GUID' then left(sha256(value), 16) else substitute end as output from sub""")
def strategy_by_type(spark, folder):
    return _values(spark, folder).select(
        "id", "start", "entity_type",
        by_type(F.col("text"), F.col("entity_type"), CHOICES).alias("output"))


@query("mapping_key", f"with k as (select id, {o.key('text', o.q('OTHER'))} as h, {o.key('text', o.q('OTHER'), 'salt:')} as g from ({MESSAGES.sql})) select id, h as original_hash, g as keyed_hash, ('0x' || substr(h, 1, 15))::bigint as mapping_id from k")
def mapping_key_query(spark, folder):
    v, t = F.col("text"), F.lit("OTHER")
    return MESSAGES.frame(spark, folder).select(
        "id", mapping_key(v, t).alias("original_hash"),
        mapping_key(v, t, "salt:").alias("keyed_hash"),
        mapping_id(mapping_key(v, t)).alias("mapping_id"))
