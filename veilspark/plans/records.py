"""Queries on sign-in records and the before/after comparison."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, functions as F

from ..functions.patterns import AUDIT_PATTERNS
from ..operators import compare, records
from ..operators.cleaning import CleanConfig, clean_texts
from ..operators.leaks import corpus_leaks
from ..session import fresh_path, materialize
from ..sources import files
from ..sources.derived import MESSAGES, SIGNINS, Derived, guid, pad, s, table
from . import oracle as o
from .registry import query

REC = f"rec as ({SIGNINS.sql})"
_FIELDS = "vals as (" + " union all ".join(
    f"select entry, {o.q(f)} as field, {f} as value from rec where regexp_matches({f}, '\\S')"
    for f in records.FIELDS) + ")"
_PATH = {"latitude": "$.geoCoordinates.latitude", "longitude": "$.geoCoordinates.longitude"}


def _json(field: str, key: str) -> str:
    return (f"(case when json_valid({field}) then json_extract_string({field}, "
            f"{o.q(_PATH.get(key, '$.' + key))}) end)")


def _json_rows() -> str:
    rows = []
    for f, keys in records.JSON_FIELDS.items():
        for k in keys:
            keep = "v is not null" if k in records.COORDINATES else \
                "regexp_matches(v, '\\S') and not starts_with(v, '{PII')"
            rows.append(f"select entry, {o.q(f'{f}.{k}')} as field, v as value from "
                        f"(select entry, {_json(f, k)} as v from rec) where {keep}")
    return "jvals as (" + " union all ".join(rows) + ")"


ALL = f"{REC}, {_FIELDS}, {_json_rows()}, every as (select * from vals union all select * from jvals)"
SRC = "src as materialized (select row_number() over () as id, value as text from (select distinct value from every))"
WORDS = (f"with {ALL}, {SRC},\n{o.detections('src')},\n{o.resolved('src')},\n{o.keyed()},\n"
         f"{o.rewritten('src')},\nwords as (select text as value, anonymized_text as cleaned from src join done using (id))\n")


def _records(spark, folder) -> DataFrame:
    return SIGNINS.frame(spark, folder)


def _dictionary(spark, folder, values: DataFrame) -> DataFrame:
    n = table(spark, folder, SIGNINS.source).count()  # by the footers of the file
    return records.dictionary(values, spread=records.value_tasks(spark, n))


@query("records_extract", f"with {REC}, {_FIELDS} select * from vals")
def records_extract(spark, folder):
    return records.extract_values(_records(spark, folder), "entry")


@query("records_extract_json", f"with {REC}, {_json_rows()} select * from jvals")
def records_extract_json(spark, folder):
    return records.extract_json_values(_records(spark, folder), "entry")


@query("records_unique", f'with {ALL} select field, count(*) as "values", count(distinct value) as unique_values from every group by 1')
def records_unique(spark, folder):
    return records.unique_values(records.all_values(_records(spark, folder), "entry"))


@query("records_dictionary", WORDS + "select * from words")
def records_dictionary(spark, folder):
    return _dictionary(spark, folder, records.all_values(_records(spark, folder), "entry"))


@query("records_apply_dictionary", WORDS + "select entry, field, value, cleaned from every join words using (value)")
def records_apply_dictionary(spark, folder):
    values = records.all_values(_records(spark, folder), "entry")
    return records.apply_dictionary(values, _dictionary(spark, folder, values), "entry")


def _clean_sql(outputs: dict[str, str]) -> str:
    """Wide rows: each output joined to the dictionary, unchanged where it is not listed."""
    joins, columns = [], []
    for i, (name, value) in enumerate(outputs.items()):
        joins.append(f"left join words w{i} on w{i}.value = r.{name}")
        columns.append(f"coalesce(w{i}.cleaned, r.{name}) as {name}")
    picked = ", ".join(f"{v} as {n}" for n, v in outputs.items())
    return (f"select entry, {', '.join(columns)} from (select entry, {picked} from rec) r "
            + " ".join(joins))


@query("records_clean", WORDS + _clean_sql({f: f for f in records.FIELDS}))
def records_clean(spark, folder):
    return records.clean_records(_records(spark, folder)).select("entry", *records.FIELDS)


_JSON_OUT = {
    "city": _json("LocationDetails", "city"), "state": _json("LocationDetails", "state"),
    "latitude": _json("LocationDetails", "latitude"),
    "longitude": _json("LocationDetails", "longitude"),
    "deviceId": _json("DeviceDetail", "deviceId"),
    "displayName": _json("DeviceDetail", "displayName"),
}


@query("records_clean_json", WORDS + f"""select c.* replace (latitude::double as latitude, longitude::double as longitude), country, system, raw from ({_clean_sql(_JSON_OUT)}) c
 join (select entry, {_json('LocationDetails', 'countryOrRegion')} as country, {_json('DeviceDetail', 'operatingSystem')} as system,
 case when not json_valid(LocationDetails) then LocationDetails end as raw from rec) using (entry)""")
def records_clean_json(spark, folder):
    rows = records.clean_records(_records(spark, folder))
    place = F.from_json("LocationDetails",
                        "city string, state string, countryOrRegion string, "
                        "geoCoordinates struct<latitude:double,longitude:double>")
    device = F.from_json("DeviceDetail", "deviceId string, displayName string, operatingSystem string")
    return rows.select("entry", "LocationDetails", place.alias("p"), device.alias("d")).select(
        "entry", "p.city", "p.state", "p.geoCoordinates.latitude", "p.geoCoordinates.longitude",
        "d.deviceId", "d.displayName", F.col("p.countryOrRegion").alias("country"),
        F.col("d.operatingSystem").alias("system"),
        F.when(~F.col("LocationDetails").startswith("{"), F.col("LocationDetails")).alias("raw"))


# JSON of every kind around the cleaned keys; the other engine puts the parts together.
_Q, _B = "' || chr(34) || '", "' || chr(92) || '"  # engines read escapes in literals differently
_PLACE_JSON = (
    """'{{"zip":null,"altitude":' || a || ',"city":"' || {city} || '","tags":["b",{{"x":null,"a":[1,2.5]}},' || a || '],'"""
    """ || '"state":' || t || ',"geoCoordinates":{{"datum":"WGS{b}"84","longitude":null,"latitude":' || {latitude} || '}},"flag":false}}'""")
_DEVICE_JSON = (
    """'{{"trustType":"Azure {b}{q}AD{b}{q}","deviceId":"' || {device} || '","isCompliant":null,"displayName":' || a || '}}'""")
_SHAPE = Derived("orders", {"o": "o_orderkey", "k": "o_custkey"}, {
    "entry": "o", "a": s("o % 97"), "t": """case o % 3 when 0 then 'null' when 1 then '["Stow-In-The-Wold"]' else '{"s":1}' end""",
    "city": f"case k % 3 when 0 then 'Newton-On-Tees' when 1 then 'Town' || {s('k % 7')} else '{{PII' || {s('k')} || '}}' end",
    "latitude": f"{s('k % 90')} || '.' || {pad('k * 7919 % 100000', 5)} || '7'", "device": guid("k + 1")})
_SHAPED = {"LocationDetails": _PLACE_JSON.format(city="city", latitude="latitude", b=_B),
           "DeviceDetail": _DEVICE_JSON.format(device="device", b=_B, q=_Q)}


@query("records_json_any_shape", f"""with rec as ({_SHAPE.sql}), every as (select city as value from rec where not starts_with(city, '{{PII')
 union select latitude from rec union select device from rec), {SRC},
{o.detections('src')},
{o.resolved('src')},
{o.keyed()},
{o.rewritten('src')},
words as (select text as value, anonymized_text as cleaned from src join done using (id)),
new as (select entry, a, t, coalesce(c.cleaned, city) as city, l.cleaned as latitude, d.cleaned as device from rec
 left join words c on c.value = city join words l on l.value = latitude join words d on d.value = device)
select entry, {_SHAPED['LocationDetails']} as LocationDetails, {_SHAPED['DeviceDetail']} as DeviceDetail from new""")
def records_json_any_shape(spark, folder):
    rows = _SHAPE.frame(spark, folder).selectExpr("entry", *[f"{e} as {n}" for n, e in _SHAPED.items()])
    return records.clean_records(rows, fields=())


_KNOWN = {"Identity": "PERSON", "UniqueTokenIdentifier": "GUID"}


@query("records_clean_typed", f"with {REC} select entry, "
       + ", ".join(f"{o.substitutes(f, o.key(f, o.q(t)))[t]} as {f}" for f, t in _KNOWN.items())
       + " from rec")
def records_clean_typed(spark, folder):
    rows = records.clean_records(_records(spark, folder), field_types=_KNOWN)
    return rows.select("entry", *_KNOWN)


@query("records_summary", WORDS + """select count(*) as unique_values, count(*) filter (where value <> cleaned) as values_anonymized,
 (select count(*) from rec) as total_entries, (select count(*) from every) as "values" from words""")
def records_summary(spark, folder):
    rows = _records(spark, folder)
    values = records.all_values(rows, "entry")
    return records.summary(rows, values, _dictionary(spark, folder, values))


_ISO = "strftime({0}, '%Y-%m-%dT%H:%M:%S') || case when microsecond({0}) % 1000000 = 0 then '' else strftime({0}, '.%f') end"


@query("records_serialize", f"select event_id, {_ISO.format('ts')} as ts, user_id, event_type, value, props from events")
def records_serialize(spark, folder):
    return records.serializable(table(spark, folder, "events"))


@query("windowed_scan", """select event_id, ts, event_type from events where ts > timestamp '2024-01-10' - interval 36 hours and ts <= timestamp '2024-01-10'
 order by ts desc, event_id limit 500""")
def windowed_scan(spark, folder):
    return files.windowed_scan(table(spark, folder, "events"), "ts", "event_id",
                               datetime(2024, 1, 10), "36h", 500).select(
        "event_id", "ts", "event_type")


def _folder(spark, name: str) -> str:
    return fresh_path(spark, name)


@query("records_load", f"with {REC} select * exclude (TimeGenerated), {_ISO.format('TimeGenerated')} as TimeGenerated from rec")
def records_load(spark, folder):
    rows = records.serializable(_records(spark, folder))
    path = _folder(spark, "records_load")
    files.write_records(rows, path)
    return files.read_records(spark, path, rows.schema, multiline=False)


@query("texts_csv", "select n_nationkey as id, n_name || ', ' || r_name || chr(10) || '\"x\"' as text from nation join region on n_regionkey = r_regionkey")
def texts_csv(spark, folder):
    nation, region = (table(spark, folder, t) for t in ("nation", "region"))
    rows = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).selectExpr(
        "n_nationkey as id", "n_name || ', ' || r_name || chr(10) || '\"x\"' as text")
    path = _folder(spark, "texts_csv")
    files.write_csv(rows, path)
    return files.read_texts(spark, path, "csv", header="true", multiLine="true",
                            escape="\\", inferSchema="false")


# Comparison. For the pairs the clean side lacks the entries with a very short duration.
_CLEAN_LOST = "DurationMs > 5"


def _sides(spark, folder) -> tuple[DataFrame, DataFrame]:
    original = records.serializable(_records(spark, folder))
    return original, records.clean_records(original)


def _values(spark, folder) -> DataFrame:
    fields = ["entry", *records.FIELDS]
    original, clean = _sides(spark, folder)
    return compare.paired_values(original.select(*fields), clean.select(*fields), "entry")


_POS = " union all ".join(
    f"select entry, DurationMs, {i} as slot, {o.q(f)} as path, {f} as value from rec where {f} <> ''"
    for i, f in enumerate(records.FIELDS))
PAIRS = WORDS + f""", flat as (select *, row_number() over (partition by entry order by slot) - 1 as position from ({_POS})),
pairs as (select entry, position, path, value as original, coalesce(cleaned, value) as cleaned from flat left join words using (value))
"""


@query("compare_pairs", f"with {REC} select count(*) filter (where {_CLEAN_LOST}) as paired, count(*) filter (where not ({_CLEAN_LOST})) as only_original, 0 as only_clean from rec")
def compare_pairs(spark, folder):
    # Pairing needs the keys only, and cleaning does not touch them.
    keys = _records(spark, folder).select("entry", "DurationMs")
    return compare.pair_counts(keys, keys.filter(_CLEAN_LOST), "entry")


@query("compare_values", PAIRS + "select * from pairs")
def compare_values(spark, folder):
    return _values(spark, folder)


_HITS = ", ".join(
    f"sum(len(regexp_extract_all(original, {o.q(r)})))::bigint as o_{k}, "
    f"sum(len(regexp_extract_all(cleaned, {o.q(r)})))::bigint as c_{k}"
    for k, r in AUDIT_PATTERNS.items())


@query("compare_pattern_hits", PAIRS + f", hits as (select {_HITS} from pairs) " + " union all ".join(
    f"select {o.q(k)} as kind, o_{k} as in_original, c_{k} as in_clean from hits" for k in AUDIT_PATTERNS))
def compare_pattern_hits(spark, folder):
    return compare.pattern_hits(_values(spark, folder))


@query("compare_by_field", PAIRS + "select path as field, count(*) as changes from pairs where original <> cleaned group by 1")
def compare_by_field(spark, folder):
    return compare.by_field(_values(spark, folder))



def _sum(column: str) -> str:
    return " + ".join(f"sum(len(regexp_extract_all({column}, {o.q(r)})))"
                      for r in AUDIT_PATTERNS.values())


@query("compare_summary", PAIRS + f""", n as (select count(*) as t from rec),
m as (select count(distinct entry) filter (where original <> cleaned) as m, count(*) filter (where original <> cleaned) as c,
 ({_sum('original')})::bigint as b, ({_sum('cleaned')})::bigint as a from pairs)
select t as total_entries, m as modified_entries, t - m as unchanged_entries, round(100 * m / t, 1) as modified_share, c as total_changes,
 b as hits_in_original, a as hits_in_clean, b - a as hits_removed from n, m""")
def compare_summary(spark, folder):
    return compare.summary(_values(spark, folder), _records(spark, folder), "entry")


@query("compare_samples", PAIRS + """select entry, path as field, original, cleaned from pairs where original <> cleaned
 order by entry, position limit 20""")
def compare_samples(spark, folder):
    return compare.samples(_values(spark, folder), "entry")


@query("compare_report", PAIRS + """, m as (select path as field, count(*) as changes from pairs where original <> cleaned group by 1),
 s as (select entry, path as field, original, cleaned from pairs where original <> cleaned order by entry, position limit 20)
select 'fields' as part, to_json({'field': field, 'changes': changes})::varchar as line from m
 union all select 'samples', to_json({'entry': entry, 'field': field, 'original': original, 'cleaned': cleaned})::varchar from s""")
def compare_report(spark, folder):
    """The tables of a comparison, written and read back line by line."""
    pairs = materialize(_values(spark, folder), "pairs")
    path = fresh_path(spark, "report")
    files.write_report({"fields": compare.by_field(pairs), "samples": compare.samples(pairs, "entry")}, path)
    return files.read_report(spark, path, ["fields", "samples"])


@query("compare_changed_entries", PAIRS + """select entry, count(*) as n, string_agg(path, ',' order by position) as columns
 from pairs where original <> cleaned group by 1""")
def compare_changed_entries(spark, folder):
    original, clean = _sides(spark, folder)
    fields = ["entry", *records.FIELDS]
    return compare.changed_entries(original.select(*fields), clean.select(*fields), "entry")


@query("flatten_paths", """with lines as (select l_orderkey as id, l_linenumber, l_returnflag, l_linestatus,
 row_number() over (partition by l_orderkey order by l_linenumber, l_returnflag, l_linestatus) - 1 as i from lineitem),
every as (select o_orderkey as id, 0 as slot, 'priority' as path, o_orderpriority as value from orders
 union all select o_orderkey, 1, 'client.name', 'client ' || o_custkey::varchar from orders
 union all select o_orderkey, 2, 'client.tag', case when o_custkey % 3 = 0 then '' else 'x' end from orders
 union all select id, 3 + 2 * i, 'lines[' || i::varchar || '].flag', l_returnflag from lines
 union all select id, 4 + 2 * i, 'lines[' || i::varchar || '].status', l_linestatus from lines)
select id, row_number() over (partition by id order by slot) - 1 as position, path, value from every where value <> '' and id in (select o_orderkey from orders)""")
def flatten_paths(spark, folder):
    orders, lines = table(spark, folder, "orders"), table(spark, folder, "lineitem")
    # Lines of an order are few by the data model.
    nested = lines.groupBy("l_orderkey").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("l_linenumber", "l_returnflag", "l_linestatus"))),
        lambda x: F.struct(x["l_returnflag"].alias("flag"), x["l_linestatus"].alias("status")),
    ).alias("lines"))
    rows = orders.join(nested, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("priority"),
        F.struct(F.expr("'client ' || cast(o_custkey as string)").alias("name"),
                 F.expr("case when o_custkey % 3 = 0 then '' else 'x' end").alias("tag"))
        .alias("client"), "lines")
    return compare.flatten(rows, "id")


@query("leak_check", o.full(MESSAGES.sql) + f""", again as (with {o.detections('(select id, anonymized_text as text from done)')} select id, {o.key('value', 'entity_type')} as h from det)
select (select count(*) from src) as texts, (select count(*) from sub) as spans_replaced, (select count(*) from again) as spans_after,
 (select count(*) from again a where exists (select 1 from sub s where s.id = a.id and s.h = a.h)) as leaked""")
def leak_check(spark, folder):
    return compare.leaks(clean_texts(MESSAGES.frame(spark, folder)))


# Every fiftieth cleaned text names a client of another one, or of none.
_PLANTED = "case when id % 50 = 0 then anonymized_text || ' see client' || cast(id % 997 as {0}) || '@mail' || cast(id % 7 as {0}) || '.example.com' else anonymized_text end"
_LOOKED_FOR = ("EMAIL_ADDRESS", "US_SSN", "GUID", "URL", "IP_ADDRESS", "IBAN_CODE")


@query("leak_corpus", o.full(MESSAGES.sql) + f""", planted as (select id, {_PLANTED.format('varchar')} as text from done),
again as (with {o.detections('planted', types=list(_LOOKED_FOR))} select id, entity_type, start, end_, {o.key('value', 'entity_type')} as h from det)
select id, entity_type, start, end_ as "end", h as original_hash from again where exists (select 1 from sub where sub.h = again.h)""")
def leak_corpus(spark, folder):
    """Originals in any cleaned text; some are planted."""
    cleaned = materialize(clean_texts(MESSAGES.frame(spark, folder)), "cleaned")
    originals = cleaned.select(F.explode("substitutions").alias("s")).select("s.original_hash", "s.entity_type")
    planted = cleaned.select("id", F.expr(_PLANTED.format("string")).alias("anonymized_text"))
    return corpus_leaks(planted, originals, CleanConfig(entity_types=list(_LOOKED_FOR)))
